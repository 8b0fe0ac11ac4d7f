"""Turn numbers, eligibility and sticky identifiers over micro-batches of any size.

Each micro-batch goes through the same skew-safe scan as a batch job. What a session brought into
earlier micro-batches enters the scan as one extra record that sorts before all others. State is kept
as one small table of additions per micro-batch, named after its number: a repeated micro-batch reads
the same earlier state and overwrites its own output, so every turn is numbered exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleystat.operators.scan import running
from parleystat.operators.skew import heavy_keys, order_struct
from parleystat.operators.turns import ORDER
from parleystat.streaming.sinks import places
from parleystat.streaming.turns import followed_columns, narrow_turns

_MERGE_EVERY = 32
_STORED = ("stored_article", "stored_response")


def _combined(rows: DataFrame, weight: Column, at: Column) -> DataFrame:
    """Per session: the turns added up and the last identifiers seen."""
    return rows.groupBy("session_id").agg(
        F.sum(weight).alias("weight"),
        *[F.max_by(name, F.when(F.col(name).isNotNull(), at)).alias(name) for name in _STORED],
    )


def _state_before(spark: SparkSession, folder: str, number: int, schema: T.StructType) -> DataFrame | None:
    """What all micro-batches before `number` add up to. Every 32 of them are merged into one table."""
    if number == 0:
        return None
    base = number - number % _MERGE_EVERY
    numbered = T.StructType([*schema, T.StructField("batch", T.LongType())])
    reader = spark.read.schema(numbered).option("basePath", folder)
    merged = f"{folder}-merged/{base}"
    if number == base:
        parts = [f"{folder}/batch={n}" for n in range(base - _MERGE_EVERY, base)]
        added = reader.parquet(*parts)
        previous = base - _MERGE_EVERY
        if previous:
            older = spark.read.schema(schema).parquet(f"{folder}-merged/{previous}")
            added = added.unionByName(older.withColumn("batch", F.lit(-1).cast("long")))
        _combined(added, F.col("weight"), F.col("batch")).write.mode("overwrite").parquet(merged)
        return spark.read.schema(schema).parquet(merged)
    added = reader.parquet(*[f"{folder}/batch={n}" for n in range(base, number)])
    if base:
        older = spark.read.schema(schema).parquet(merged)
        added = added.unionByName(older.withColumn("batch", F.lit(-1).cast("long")))
    return _combined(added, F.col("weight"), F.col("batch"))


def replay_turns(
    turns: DataFrame,
    variant: str = "text",
    order: Sequence[str] = ORDER,
    name: str = "replay",
    out: str | None = None,
    checkpoint: str | None = None,
    **skew: int,
) -> DataFrame:
    """Run the stream over what is available now; returns all numbered turns so far.

    Turns of a session are taken in `order` within a micro-batch and in arrival order across them. With `out` and
    `checkpoint` named, a later call goes on where this one ended.
    """
    spark = turns.sparkSession
    out, checkpoint = places(spark, name, out, checkpoint)
    state_schema = T.StructType(
        [T.StructField("session_id", T.StringType()), T.StructField("weight", T.LongType())]
        + [T.StructField(field, T.StringType()) for field in _STORED]
    )

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = narrow_turns(batch, order).withColumn("weight", F.col("counted").cast("long")).persist()
        try:
            added = _combined(rows, F.col("weight"), order_struct(order))
            added.write.mode("overwrite").parquet(f"{out}-state/batch={number}")
            earlier = _state_before(session, f"{out}-state", number, state_schema)
            entering = rows.withColumn("turn", F.lit(True))
            if earlier is not None:
                present = session.read.schema(state_schema).parquet(f"{out}-state/batch={number}")
                known = earlier.join(present.select("session_id"), "session_id", "left_semi")
                entering = entering.unionByName(known.withColumn("turn", F.lit(False)), allowMissingColumns=True)
            scanned = running(
                entering,
                heavy_keys(rows, "session_id", **skew),
                order,
                sums={"prior_turns": F.col("weight")},
                lasts={f"prior_{field}": F.col(field) for field in _STORED},
            )
            followed_columns(scanned.where("turn"), variant, order).write.mode("overwrite").parquet(
                f"{out}/batch={number}"
            )
        finally:
            rows.unpersist()

    query = (
        turns.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")
