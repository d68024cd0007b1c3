"""Every query of the engine runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import duckdb
import pandas as pd
import pytest

from marlstone.plans import catalog, details, files  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if pd.isna(value):
        return None
    if isinstance(value, (bool, str)):
        return value
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return int(number) if number.is_integer() else round(number, 9)


def rows(frame):
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    ours = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.SQL:
        assert len(ours)
        return
    theirs = duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["room", "n"]
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())


def test_merge_fragments_reads_all_points(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog.objects, "merge_fragments", lambda rows: seen.append(rows) or rows)
    catalog.QUERIES["merge_fragments"](spark, sf)
    assert {len(r.points) for r in seen[0].select("points").collect()} == {512}


def test_mean_direction_has_all_components(spark, sf):
    got = catalog.QUERIES["mean_direction"](spark, sf)
    assert {r["count"] for r in got.groupBy("object_id").count().collect()} == {64}


def test_masks_of_all_parts(spark, sf):
    parts = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    share = lambda size, i, j: sum(max(0, min((i + 1) * 20 / 7, r + 1) - max(i * 20 / 7, r)) * max(0, min((j + 1) * 20 / 6, c + 1) - max(j * 20 / 6, c)) for r in range(20) for c in range(20) if (r * 7 + c * 3 + size) % 23) / (400 / 42)
    by_size = {n: {(i, j): round(share(n, i, j), 5) for i in range(7) for j in range(6) if share(n, i, j) >= 0.5} for n in set(parts.values())}
    got = {(r.frame_id, r.row, r.col): round(r.share_ppm / 1e6, 5) for r in catalog.QUERIES["coverage_fraction"](spark, sf).collect()}
    assert got == pytest.approx({(p, *cell): v for p, n in parts.items() for cell, v in by_size[n].items()}, abs=2e-5)
    assert {r.frame_id for r in catalog.QUERIES["depth_core"](spark, sf).select("frame_id").distinct().collect()} == set(parts)


def test_links_to_all_objects(spark, sf):
    everything = {r.object_id for r in catalog.bridge.objects(spark, sf).collect()}
    named = {r.object_id: r.label for r in catalog.named_objects(spark, sf).collect()}
    assert set(named) == everything and all(named.values())
    linked = {r.object_id for r in catalog.QUERIES["rule_links"](spark, sf).collect()}
    assert linked <= everything and max(linked) >= 160
