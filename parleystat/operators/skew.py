"""Keys that hold too many rows for one task, and joins and lookups that stay clear of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_FLOOR = 1_000_000
MAX_HEAVY = 10_000


@dataclass(frozen=True)
class HeavyKeys:
    """Keys with more than `limit` rows. `limit` is at least total/max_heavy, so there are fewer than
    `max_heavy` of them however large the data: the table may always be broadcast."""

    key: str
    limit: int
    total: int
    table: DataFrame | None  # (key, rows); None when no key is heavy

    def __bool__(self) -> bool:
        return self.table is not None

    def matches(self, rows: DataFrame, table: DataFrame) -> Column:
        return rows[self.key].eqNullSafe(table[self.key])

    def only(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.table), self.matches(rows, self.table), "left_semi")

    def without(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.table), self.matches(rows, self.table), "left_anti")


def heavy_keys(rows: DataFrame, key: str, floor: int = ROW_FLOOR, max_heavy: int = MAX_HEAVY) -> HeavyKeys:
    """Count first (file footers suffice for a scan); only a large input is grouped by key."""
    total = rows.count()
    limit = max(floor, total // max_heavy)
    if total <= limit:
        return HeavyKeys(key, limit, total, None)
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > limit).collect()
    if not found:
        return HeavyKeys(key, limit, total, None)
    schema = T.StructType([rows.schema[key], T.StructField("rows", T.LongType())])
    schema[key].nullable = True
    return HeavyKeys(key, limit, total, rows.sparkSession.createDataFrame(found, schema))


def lookup_join(rows: DataFrame, table: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """Left join with a table that has one row per key.

    Rows of ordinary keys meet the table in a shuffle join. Rows of heavy keys meet the few table rows
    they need in a broadcast join, so no task receives a heavy key whole.
    """
    key = heavy.key
    if not heavy:
        return rows.join(table, key, "left")
    ordinary = heavy.without(rows).join(table, key, "left")
    needed = heavy.only(table.where(F.col(key).isNotNull()))
    return ordinary.unionByName(heavy.only(rows).join(F.broadcast(needed), key, "left").select(ordinary.columns))


def salted_lookup_join(rows: DataFrame, table: DataFrame, heavy: HeavyKeys, spread: Sequence[str]) -> DataFrame:
    """Left join with a table that has one row per key, for rows too costly to read twice.

    The rows of a heavy key are dealt out over as many lanes as they fill, by a hash of the `spread`
    columns, which must tell rows apart; the key's table row is copied to each of its lanes.
    """
    key = heavy.key
    if not heavy:
        return rows.join(table, key, "left")
    lanes = heavy.table.select(F.col(key).alias("_heavy"), F.ceil(F.col("rows") / heavy.limit).alias("_lanes"))

    def with_lanes(side: DataFrame) -> DataFrame:
        return side.join(F.broadcast(lanes), side[key].eqNullSafe(F.col("_heavy")), "left")

    lane = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_lanes")), F.lit(0).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("_lanes", F.lit(1)).cast("long") - 1)
    salted = with_lanes(rows).withColumn("_lane", lane).drop("_heavy", "_lanes")
    copies = with_lanes(table).withColumn("_lane", F.explode(every)).drop("_heavy", "_lanes")
    return salted.join(copies.hint("merge"), [key, "_lane"], "left").drop("_lane")


def has_at_most(table: DataFrame, rows: int) -> bool:
    """Whether the table holds no more than `rows` rows; reads no columns and stops once it knows."""
    return table.select(F.lit(1).alias("one")).limit(rows + 1).count() <= rows


def order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(name) for name in order])
