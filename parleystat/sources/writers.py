"""Sinks for logs, exports and model results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleystat import schemas as S


def append_turns(turns: DataFrame, path: str) -> None:
    """Append finished turns to a Parquet turn log."""
    turns.select(*[F.col(f.name).cast(f.dataType) for f in S.TURN_LOG]).write.mode("append").parquet(path)


#: Folders of a clustered log, and about how large its row groups are.
LOG_BUCKETS = 64
ROW_GROUP = 4 << 20
BUCKET = "bucket"
CLUSTERED_LOG = T.StructType([*S.TURN_LOG, T.StructField(BUCKET, T.IntegerType())])


def session_bucket(session_id: Column, buckets: int = LOG_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


def append_clustered(turns: DataFrame, path: str, buckets: int = LOG_BUCKETS, row_group: int = ROW_GROUP) -> None:
    """Append finished turns to a log in folders by session, sorted by session and time, in small row groups.

    Turns are dealt out by ranges of (folder, session, time), so a session that holds a third of them is written by as
    many tasks as it fills, each a stretch of it. Every append adds files to the folders it touches; `recluster` makes
    few of many.
    """
    order = (BUCKET, "session_id", "response_time", "_id")
    rows = turns.select(*[F.col(f.name).cast(f.dataType) for f in S.TURN_LOG])
    rows = rows.withColumn(BUCKET, session_bucket(F.col("session_id"), buckets))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.write.mode("append").partitionBy(BUCKET).option("parquet.block.size", row_group).parquet(path)


def recluster(spark: SparkSession, source: str, target: str, buckets: int = LOG_BUCKETS, row_group: int = ROW_GROUP) -> None:
    """Write a clustered log anew, each folder's turns sorted as a whole."""
    append_clustered(spark.read.schema(CLUSTERED_LOG).parquet(source).drop(BUCKET), target, buckets, row_group)


def union_of_documents(parts: Sequence[DataFrame]) -> DataFrame:
    """Documents with differing keys in one table: the union of their columns, `_id` as text."""
    texted = [p.withColumn("_id", F.col("_id").cast("string")) if "_id" in p.columns else p for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), texted)


_MICROSECONDS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    # Spark would otherwise trim cells and cut times to milliseconds.
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampFormat": _MICROSECONDS,
    "timestampNTZFormat": _MICROSECONDS,
}


def export_csv(log: DataFrame, path: str) -> None:
    """The log as CSV files with a header. Line breaks, quotes and outer spaces inside cells survive a
    re-read; nested values are written as JSON."""
    nested = [f.name for f in log.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    log = log.withColumns({name: F.to_json(F.col(f"`{name}`")) for name in nested}) if nested else log
    log.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def preview(log: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows in a stated order."""
    return log.orderBy(*order).limit(rows)


def write_results(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per model and outcome, as the tables carry both as columns."""
    writer = table.write.mode("overwrite").partitionBy("model", "outcome").format(fmt)
    (writer.options(**CSV_OPTIONS) if fmt == "csv" else writer).save(path)
