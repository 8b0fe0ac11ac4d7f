"""Running values per session, in an order, without ever needing a whole session in one task.

An ordinary session is one window partition. A heavy session is cut along the order into segments of
about `limit` rows. Each segment is scanned on its own; what the segments before it add up to comes
from a small table of segment summaries (fewer than two per heavy-key slot), which is broadcast.
The cuts come from a sample, but the result does not depend on where they fall.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleystat.operators.skew import HeavyKeys, order_struct

_SEGMENT = "_segment"
_SAMPLES_PER_SEGMENT = 64
_COARSE = 64


def _cut_points(rows: DataFrame, heavy: HeavyKeys, order: Sequence[str]) -> DataFrame:
    """One row per heavy session: its sorted cut points, and every 64th of them for a quick lookup.

    About 64 places per segment are sampled by hash, and every 64th of them becomes a cut, so the sample
    of even the largest session stays small (at most 64 times the number of heavy-key slots).
    """
    stride = max(1, heavy.limit // _SAMPLES_PER_SEGMENT)
    places = heavy.only(rows.select(heavy.key, order_struct(order).alias("at")))
    sample = places.where(F.pmod(F.xxhash64("at"), F.lit(stride)) == 0)
    per_cut = max(1, heavy.limit // stride)
    ranked = sample.withColumn("rank", F.row_number().over(Window.partitionBy(heavy.key).orderBy("at")))
    cuts = (
        ranked.where(F.col("rank") % per_cut == 0)
        .groupBy(heavy.key)
        .agg(F.sort_array(F.collect_list("at")).alias("cuts"))
        .withColumn("coarse", F.expr(f"transform(sequence(1, size(cuts), {_COARSE}), i -> element_at(cuts, i))"))
    )
    # Held by the driver (at most one cut per `limit` heavy rows), so every use sees the same cuts.
    return rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def _with_segments(rows: DataFrame, heavy: HeavyKeys, order: Sequence[str], cuts: DataFrame) -> DataFrame:
    cuts = cuts.withColumnRenamed(heavy.key, "_cut_key")
    at = order_struct(order)
    joined = rows.join(F.broadcast(cuts), rows[heavy.key].eqNullSafe(F.col("_cut_key")), "left")
    block = F.greatest(F.size(F.filter("coarse", lambda c: c <= at)) - 1, F.lit(0))
    inside = F.filter(F.slice("cuts", block * _COARSE + 1, F.lit(_COARSE)), lambda c: c <= at)
    segment = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(block * _COARSE + F.size(inside))
    return joined.withColumn(_SEGMENT, segment.cast("int")).drop("_cut_key", "cuts", "coarse")


def running(
    rows: DataFrame,
    heavy: HeavyKeys,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    firsts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add, per row: `sums` over the earlier rows of its session, the last non-null of `lasts` and the
    first non-null of `firsts` among them, and `totals` over the whole session."""
    sums, lasts, totals, firsts = dict(sums or {}), dict(lasts or {}), dict(totals or {}), dict(firsts or {})
    key = heavy.key
    keys = [key]
    if heavy:
        cuts = _cut_points(rows, heavy, order)
        rows = _with_segments(rows, heavy, order, cuts)
        keys.append(_SEGMENT)
    ordered = Window.partitionBy(*keys).orderBy(*[F.col(name).asc_nulls_first() for name in order])
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    scanned = rows.select(
        "*",
        *[F.coalesce(F.sum(e.cast("long")).over(earlier), zero).alias(n) for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(earlier).alias(n) for n, e in lasts.items()],
        *[F.first(e, ignorenulls=True).over(earlier).alias(n) for n, e in firsts.items()],
        *[F.coalesce(F.sum(e.cast("long")).over(whole), zero).alias(n) for n, e in totals.items()],
    )
    if not heavy:
        return scanned
    carry = _carried(rows, heavy, order, sums, lasts, totals, firsts)
    added = {_SEGMENT, *sums, *lasts, *totals, *firsts}
    joined = scanned.join(
        F.broadcast(carry),
        scanned[key].eqNullSafe(carry["_carry_key"]) & (scanned[_SEGMENT] == carry["_carry_segment"]),
        "left",
    )
    return joined.select(
        *[c for c in scanned.columns if c not in added],
        *[(F.col(n) + F.coalesce(f"_before_{n}", zero)).alias(n) for n in sums],
        *[F.coalesce(n, f"_before_{n}").alias(n) for n in lasts],
        *[F.coalesce(f"_before_{n}", n).alias(n) for n in firsts],
        *[F.coalesce(f"_all_{n}", n).alias(n) for n in totals],
    )


def _carried(
    rows: DataFrame,
    heavy: HeavyKeys,
    order: Sequence[str],
    sums: Mapping[str, Column],
    lasts: Mapping[str, Column],
    totals: Mapping[str, Column],
    firsts: Mapping[str, Column],
) -> DataFrame:
    """Per segment of a heavy session: what the earlier segments hold, and the session totals."""
    at = order_struct(order)
    summary = (
        heavy.only(rows)
        .groupBy(heavy.key, _SEGMENT)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(e.cast("long")).alias(f"_sum_{n}") for n, e in sums.items()],
            *[F.max_by(e, F.when(e.isNotNull(), at)).alias(f"_last_{n}") for n, e in lasts.items()],
            *[F.min_by(e, F.when(e.isNotNull(), at)).alias(f"_first_{n}") for n, e in firsts.items()],
            *[F.sum(e.cast("long")).alias(f"_total_{n}") for n, e in totals.items()],
        )
    )
    earlier = Window.partitionBy(heavy.key).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    session = Window.partitionBy(heavy.key)
    return summary.select(
        F.col(heavy.key).alias("_carry_key"),
        F.col(_SEGMENT).alias("_carry_segment"),
        *[F.sum(f"_sum_{n}").over(earlier).alias(f"_before_{n}") for n in sums],
        *[F.last(f"_last_{n}", ignorenulls=True).over(earlier).alias(f"_before_{n}") for n in lasts],
        *[F.first(f"_first_{n}", ignorenulls=True).over(earlier).alias(f"_before_{n}") for n in firsts],
        *[F.sum(f"_total_{n}").over(session).alias(f"_all_{n}") for n in totals],
    )
