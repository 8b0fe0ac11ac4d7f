"""Run a stream over what is available now, keep its results, and go on where it stopped.

A caller who names `out` and `checkpoint` can run the same stream again later: it reads only what has come since, with
the state it had. Without names both are fresh paths below the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.operators.survey import token_totals
from parleystat.session import scratch_path

#: Tables of changes that are merged into one of the next level.
MERGE = 16


def places(spark: SparkSession, name: str, out: str | None, checkpoint: str | None) -> tuple[str, str]:
    """Where results and progress go. To resume, both have to be named, as neither means anything without the other."""
    if (out is None) != (checkpoint is None):
        raise ValueError("name both the result's path and the checkpoint's, or neither")
    fresh = scratch_path(spark, name) if out is None else out.rstrip("/")
    return fresh, checkpoint or f"{fresh}-progress"


def _appended(stream: DataFrame, out: str, checkpoint: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()


def drain(stream: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Append the stream's rows to a table until the input is used up; returns the whole table."""
    out, checkpoint = places(stream.sparkSession, name, out, checkpoint)
    _appended(stream, out, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def append_turns_stream(turns: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append finished turns of a stream to a Parquet turn log, each exactly once.

    The log's own list of files says which micro-batches are in it, so one that is repeated after a failure adds
    nothing, and batch readers see whole micro-batches while the log grows. Returns the log as it is then.
    """
    _appended(turns.select(*[F.col(f.name).cast(f.dataType) for f in S.TURN_LOG]), path, checkpoint)
    return turns.sparkSession.read.schema(S.TURN_LOG).parquet(path)


def _files(spark: SparkSession, path: str):
    """The path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, f"{path}/_SUCCESS")
    return files.exists(where)


def _removed(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)


def save_changes(batch: DataFrame, number: int, out: str, merged: Callable[[DataFrame], DataFrame], every: int = MERGE) -> None:
    """Keep micro-batch `number`'s changes below `out`, and merge `every` tables of one level into one of the next.

    So there are fewer than `every` tables per level, and levels grow with the logarithm of the micro-batches. `merged`
    must not mind rows that come twice: a table stays until the one it went into is complete, and what a repeated
    micro-batch finds complete it leaves.
    """
    spark = batch.sparkSession
    end, size, level = number + 1, 1, 0

    def table(level: int, end: int) -> str:
        return f"{out}/level={level}/upto={end}"

    covering = [(k, -(-end // every**k) * every**k) for k in range(1, 64) if every**k <= max(end, 1) * every]
    if any(_complete(spark, table(k, at)) for k, at in covering):
        return
    batch.write.mode("overwrite").parquet(table(0, end))
    while end % (size * every) == 0:
        parts = [table(level, end - k * size) for k in range(every)]
        level, size = level + 1, size * every
        if not _complete(spark, table(level, end)):
            whole = spark.read.schema(batch.schema).parquet(*[p for p in parts if _complete(spark, p)])
            merged(whole).select(batch.columns).write.mode("overwrite").parquet(table(level, end))
        for part in parts:
            _removed(spark, part)


def read_changes(spark: SparkSession, out: str, schema, merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What all kept changes come to."""
    where, files = _files(spark, f"{out}/level=*/upto=*")
    found = [str(s.getPath()) for s in files.globStatus(where) or []]
    kept = [p for p in found if _complete(spark, p)]
    return merged(spark.read.schema(schema).parquet(*kept)) if kept else spark.createDataFrame([], schema)


def stream_token_totals(
    utterances: DataFrame, name: str = "tokens", out: str | None = None, checkpoint: str | None = None, every: int = MERGE
) -> DataFrame:
    """Running token totals per person. Each micro-batch keeps the totals it changed; totals only grow, so the largest
    is the latest, and tables of changes are merged by level."""
    spark = utterances.sparkSession
    totals = token_totals(utterances)
    out, checkpoint = places(spark, name, out, checkpoint)

    def latest(changes: DataFrame) -> DataFrame:
        return changes.groupBy("person_id").agg(F.max("total_tokens").alias("total_tokens"))

    query = (
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: save_changes(batch, number, out, latest, every))
        .start()
    )
    query.awaitTermination()
    return read_changes(spark, out, totals.schema, latest)
