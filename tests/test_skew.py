"""Heavy keys, and the joins and scans built around them, against the plain forms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parleystat.operators.scan import running
from parleystat.operators.articles import contexts_of, may_be_sent, with_context
from parleystat.operators.skew import has_at_most, heavy_keys, lookup_join, salted_lookup_join

SKEW = {"floor": 20, "max_heavy": 1000}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = rng.choice(["hot", None, f"k{rng.randrange(300)}"])
        data.append((i, key, rng.choice([None, rng.randrange(40)]), rng.choice([None, f"v{i}"]), rng.randrange(3)))
    return spark.createDataFrame(data, "id long, key string, at int, value string, weight int").persist()


def test_heavy_keys_are_found_and_bounded(rows):
    heavy = heavy_keys(rows, "key", **SKEW)
    counts = {r["key"]: r["count"] for r in rows.groupBy("key").count().collect()}
    assert {r["key"] for r in heavy.table.collect()} == {k for k, n in counts.items() if n > 20}
    assert not heavy_keys(rows, "key")
    few = heavy_keys(rows, "key", floor=1, max_heavy=5)
    assert few.limit == 600 and few.table.count() < 5


def test_has_at_most(rows):
    assert has_at_most(rows, 3000) and not has_at_most(rows, 2999)


@pytest.mark.parametrize("skew", [{}, SKEW])
def test_lookups_equal_a_plain_join(spark, rows, skew):
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", None), ("absent", 3)], "key string, found int")
    heavy = heavy_keys(rows, "key", **skew)
    plain = sorted(map(str, rows.join(table, "key", "left").select("id", "key", "found").collect()))
    for joined in (lookup_join(rows, table, heavy), salted_lookup_join(rows, table, heavy, ["id"])):
        assert sorted(map(str, joined.select("id", "key", "found").collect())) == plain


def _brute(rows):
    sessions = {}
    for r in rows.collect():
        sessions.setdefault(r["key"], []).append(r)
    expected = {}
    for group in sessions.values():
        group.sort(key=lambda r: (r["at"] is not None, r["at"] or 0, r["id"]))
        total, seen, last = sum(r["weight"] for r in group), 0, None
        for r in group:
            expected[r["id"]] = (seen, last, total)
            seen += r["weight"]
            last = r["value"] if r["value"] is not None else last
    return expected


@pytest.mark.parametrize("skew", [{}, SKEW, {"floor": 1, "max_heavy": 10_000}, {"floor": 130, "max_heavy": 20}])
def test_running_values(rows, skew):
    scanned = running(
        rows, heavy_keys(rows, "key", **skew), ("at", "id"),
        sums={"seen": F.col("weight")}, lasts={"last": F.col("value")}, totals={"total": F.col("weight")},
    )
    got = {r["id"]: (r["seen"], r["last"], r["total"]) for r in scanned.collect()}
    assert got == _brute(rows)


def test_a_heavy_session_is_cut(rows):
    from parleystat.operators.scan import _cut_points, _with_segments

    heavy = heavy_keys(rows, "key", floor=100, max_heavy=1000)
    cut = _with_segments(rows, heavy, ("at", "id"), _cut_points(rows, heavy, ("at", "id")))
    sizes = [r["count"] for r in cut.groupBy("key", "_segment").count().collect()]
    assert max(sizes) <= 2 * heavy.limit
    assert cut.where("key = 'hot'").select("_segment").distinct().count() > 5


def test_many_cuts_use_both_lookup_levels(spark):
    rows = spark.range(4000).select(F.col("id"), F.lit("hot").alias("key"))
    scanned = running(rows, heavy_keys(rows, "key", floor=10, max_heavy=1000), ("id",), sums={"seen": F.lit(1)})
    assert scanned.where("seen <> id").count() == 0


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("count, chars, sent", [(1999, 40_000, False), (2001, 5, True), (2001, 40_000, False), (20, 40_000, True)])
def test_contexts_are_sent_by_their_measured_bytes(spark, count, chars, sent):
    articles = spark.range(count).select(F.col("id").cast("string").alias("article_id"), F.repeat(F.lit("é"), chars).alias("text"))
    turns = spark.range(50).select(F.col("id"), F.col("id").cast("string").alias("article_id"))
    assert may_be_sent(contexts_of(articles, 40_000)) == sent
    joined = with_context(turns, articles, ("id",), 40_000)
    assert ("BroadcastHashJoin" in plan_of(joined)) == sent and ("SortMergeJoin" in plan_of(joined)) != sent
    assert joined.where(F.length("article_text") == chars).count() == min(count, 50)
