"""Column functions on dialogue text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words after which a class phrase is a place rather than the subject.
PLACE_WORDS = ("beside", "by", "near", "next to", "under", "underneath", "on", "on top of", "with", "behind", "in front of", "above", "below", "opposite", "across from", "closest to", "nearest", "nearest to", "around", "against", "between", "over", "atop")
ARTICLES = ("the", "that", "this", "a", "an")
#: A place word, white space, an article, white space; there is no boundary before the place word, so "person the" matches too.
PLACE_PREFIX = rf"({'|'.join(PLACE_WORDS)})\s+({'|'.join(ARTICLES)})\s+"
# What family names lose, or change to.
FAMILY_MARKS = (("multi_clip_semantic_", ""), ("evidence_recall_", ""), ("multi_clip_cross_slot_semantic_union_", "union_"), ("generic_CrossClip", ""))


def mention_mark(text: Column, phrase: Column, object_id: Column) -> Column:
    """Put ` [#id]` after the first occurrence of the phrase, whatever its case, or at the end."""
    mark = F.concat(F.lit(" [#"), object_id.cast("string"), F.lit("]"))
    at = F.when(F.length(phrase) > 0, F.instr(F.lower(text), F.lower(phrase))).otherwise(F.lit(0))
    end = at + F.length(phrase) - 1
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), end), mark, F.substr(text, end + 1))).otherwise(F.concat(text, mark))


def alternatives_suffix(names: Column) -> Column:
    """` (or: a, b)` where there are alternatives."""
    return F.when(F.size(names) > 0, F.concat(F.lit(" (or: "), F.array_join(names, ", "), F.lit(")"))).otherwise(F.lit(""))


def quoted(label: Column) -> Column:
    """A pattern for the label as it is written; every sign in it stands for itself."""
    return F.regexp_replace(label, r"([^\p{L}\p{N}_\s])", r"\\$1")


def _class_phrase(label: Column) -> Column:
    """The label, or with an s."""
    return F.concat(quoted(label), F.lit("s?"))


def names_class(text: Column, label: Column) -> Column:
    """The text has the class as a word or words, or with an s, in any case."""
    return F.regexp_like(text, F.concat(F.lit(r"(?iU)\b"), _class_phrase(label), F.lit(r"\b")))


def is_subject(text: Column, label: Column) -> Column:
    """Some occurrence of the class phrase is not where something else is: no place word and article come before it.

    Runs of up to 64 white space characters between those are seen.
    """
    phrase = _class_phrase(label)
    before = PLACE_PREFIX.replace(r"\s+", r"\s{1,64}")
    return F.regexp_like(text, F.concat(F.lit(r"(?iU)\b"), phrase, F.lit(rf"\b(?<!{before}"), phrase, F.lit(")")))


def short_hash(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the parts' SHA-256, joined by line feeds."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)


def object_ref(text: Column) -> Column:
    """`dddd_dd#n` from a reference such as `scene 0474_03 # 19`; null if there is none."""
    bare = F.lower(F.regexp_replace(text, r"\s+", ""))
    found = F.regexp_extract(bare, r"(?:scene)?(\d{4}_\d{2})#(\d+)", 0)
    return F.when(found != "", F.regexp_replace(found, "^scene", ""))


def scene_of(clip: Column) -> Column:
    return F.replace(clip, F.lit("-full"), F.lit(""))


def family_of(name: Column) -> Column:
    """A family name without its prefixes and marks, which go in order."""
    for mark, put in FAMILY_MARKS:
        name = F.replace(name, F.lit(mark), F.lit(put))
    return name


def parse_answer(text: str | None):
    """The `answer` of a reply that is a JSON object, else of the object that its last closing brace ends, else the
    last true, false, whole number or string after `"answer":`; None if there is none."""
    for part in (text or "", last_group(text or "")):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found.get("answer")
    said = _said.findall(text or "")
    return json.loads(said[-1].replace("\n", " ")) if said else None


_said = re.compile(r'"answer"\s*:\s*(true|false|-?\d+|"[^"]*")')


def last_group(text: str) -> str:
    """From the brace that the last closing brace closes up to it; empty if there is none. Braces in strings count too."""
    end = text.rfind("}")
    opened: list[int] = []
    start = -1
    for m in re.finditer("[{}]", text[: end + 1]):
        if m[0] == "{":
            opened.append(m.start())
        else:
            start = opened.pop() if opened else -1
    return text[start : end + 1] if start >= 0 else ""


@F.pandas_udf(StringType())
def answer_json(replies: pd.Series) -> pd.Series:
    """parse_answer as JSON text."""
    return replies.map(lambda x: None if (a := parse_answer(x)) is None else json.dumps(a))


# Where the last session of a context begins, and the least length of a prefix that is worth a cache.
SESSION_MARK, LEAST_PREFIX = "\n=== session", 4000


def split_prefix(text: Column) -> tuple[Column, Column]:
    """The part of a context before its last session's header, null where that is short or there is no header, and the rest."""
    pieces = F.split(text, SESSION_MARK)
    rest = F.length(F.element_at(pieces, -1)) + len(SESSION_MARK)
    at = F.when(F.size(pieces) > 1, F.length(text) - rest)  # signs before the line feed of the last header
    cut = F.coalesce(at >= LEAST_PREFIX, F.lit(False))
    return F.when(cut, F.substr(text, F.lit(1), at + 1)), F.when(cut, F.substr(text, at + 2)).otherwise(text)
