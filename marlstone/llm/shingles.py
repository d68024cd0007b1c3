"""Hashed word shingles of whole texts, computed on Arrow's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are hashed at once.
CHUNK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUE = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=_U)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, `n` of each at least."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(n, base, _U)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets between them."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, A-Z as a-z, words being what white space (0x20, 0x09-0x0D) separates; words of each text."""
    data, at = text_bytes(texts)
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate(([True], ~solid[:-1]))))
    ends = np.flatnonzero(solid & (edge[1:] | np.concatenate((~solid[1:], [True])))) + 1
    counts = np.diff(np.searchsorted(starts, at))
    hashes = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        low, high = starts[i], ends[j - 1]
        up, down = powers(int(high - low) + 1)
        sums = np.zeros(high - low + 1, _U)
        np.cumsum(_VALUE[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        hashes[i:j] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        i = j
    return hashes, counts


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of so many words; a text of fewer words has one, of all its words."""
    hashes, counts = word_hashes(texts)
    count = max(0, len(hashes) - words + 1)
    joined = hashes[:count].copy()
    for k in range(1, words):
        joined = mixed(joined * _U(0xA0761D6478BD642F) + hashes[k : k + count])
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(joined[at : at + n - words + 1]))
        elif n:
            short = np.array([n], _U)
            for h in hashes[at : at + n]:
                short = mixed(short * _U(0xE7037ED1A0B428DB) + h)
            out.append(short)
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


def exact_shingles(text: str, words: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if len(parts) < words:
        return {tuple(parts)} if parts else set()
    return set(zip(*(parts[k:] for k in range(words))))
