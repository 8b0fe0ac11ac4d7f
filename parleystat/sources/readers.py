"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleystat import schemas as S
from parleystat.operators.articles import last_of_each
from parleystat.sources.writers import BUCKET, CLUSTERED_LOG, LOG_BUCKETS, session_bucket


def _no_nan(frame: DataFrame) -> DataFrame:
    """NaN counts as missing, and Spark's averages would otherwise be poisoned by it."""
    floats = [f.name for f in frame.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    cleaned = {name: F.when(~F.isnan(F.col(f"`{name}`")), F.col(f"`{name}`")) for name in floats}
    return frame.withColumns(cleaned) if cleaned else frame


def _conform(raw: DataFrame, schema: T.StructType, bad_numbers: str) -> DataFrame:
    """Select the declared columns by name; missing-value words become null."""
    absent = [name for name in schema.names if name not in raw.columns]
    if absent:
        raise ValueError(f"input lacks the columns {absent}")
    if bad_numbers not in ("raise", "missing"):
        raise ValueError(f"bad_numbers is 'raise' or 'missing', not {bad_numbers!r}")

    def read(field: T.StructField) -> Column:
        cell = F.col(f"`{field.name}`")
        present = F.when(~cell.isin(*S.MISSING_TOKENS), cell)
        value = present.try_cast(field.dataType)
        if bad_numbers == "raise" and not isinstance(field.dataType, T.StringType):
            told = F.concat(F.lit(f"column {field.name} holds no number: "), cell)
            value = F.when(present.isNotNull() & value.isNull(), F.raise_error(told).cast(field.dataType)).otherwise(value)
        return value.alias(field.name)

    return raw.select(*[read(field) for field in schema])


def bad_numbers(spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Per number column, how many of its cells are neither numbers nor missing: `column, n`."""
    raw = _cells(spark, path, multi_line)
    counts = []
    for field in schema:
        if not isinstance(field.dataType, T.StringType):
            cell = F.col(f"`{field.name}`")
            counts.append(F.count_if(~cell.isin(*S.MISSING_TOKENS) & cell.try_cast(field.dataType).isNull()).alias(field.name))
    totals = raw.agg(*counts)
    return totals.unpivot([], [F.col(f"`{c}`") for c in totals.columns], "column", "n")


def _cells(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    # Files whose header differs from the first one's raise instead of being read by position.
    options = {"header": True, "multiLine": multi_line, "escape": '"', "encoding": "UTF-8", "enforceSchema": False}
    names = spark.read.options(**options).csv(path).columns
    texts = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return spark.read.schema(texts).options(**options).csv(path)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = True, bad_numbers: str = "raise"
) -> DataFrame:
    """CSV with a header and doubled quotes; all files need the same header. A cell that should be a number and is
    not raises, or is missing if `bad_numbers` says so (the function of that name counts them). Quoted line breaks
    need `multi_line`, which reads each file in one task: give it many files, or turn it off where no cell holds a
    line break."""
    return _no_nan(_conform(_cells(spark, path, multi_line), schema, bad_numbers))


def _read(
    spark: SparkSession, path: str | list[str], schema: T.StructType, fmt: str, multi_line: bool
) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema, multi_line)
    raw = spark.read.format(fmt).load(path)
    return _no_nan(raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]))


def read_survey(
    spark: SparkSession, path: str | list[str], fmt: str = "csv", multi_line: bool = True
) -> DataFrame:
    return _read(spark, path, S.SURVEY, fmt, multi_line)


def read_utterances(
    spark: SparkSession, path: str | list[str], fmt: str = "csv", multi_line: bool = True
) -> DataFrame:
    return _read(spark, path, S.UTTERANCE, fmt, multi_line)


def read_turn_log(spark: SparkSession, path: str, fmt: str = "parquet", session_id: str | None = None) -> DataFrame:
    """The whole log, or one session of it (the condition reaches the scan)."""
    log = spark.read.schema(S.TURN_LOG).format(fmt).load(path)
    return log if session_id is None else log.where(F.col("session_id") == session_id)


def read_session(spark: SparkSession, path: str, session_id: str | None, buckets: int = LOG_BUCKETS) -> DataFrame:
    """One session of a clustered log in chronological order. Of the log's folders one is read, and of its files only
    the row groups whose range holds the session."""
    bucket = session_bucket(F.lit(session_id).cast("string"), buckets)
    log = spark.read.schema(CLUSTERED_LOG).parquet(path)
    found = log.where((F.col(BUCKET) == bucket) & F.col("session_id").eqNullSafe(F.lit(session_id).cast("string")))
    return found.drop(BUCKET).orderBy("response_time", "_id")


def read_clustered_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole of a clustered log."""
    return spark.read.schema(CLUSTERED_LOG).parquet(path).drop(BUCKET)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A dump of log documents, one JSON object per line, whose keys may differ: the union of the keys.

    Dumps wrap identifiers and times as `{"$oid": ...}` and `{"$date": ...}`; these are unwrapped, also where only some
    documents wrap them.
    """
    raw = spark.read.option("primitivesAsString", True).json(path)

    def plain(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StructType) and field.dataType.names in (["$oid"], ["$date"]):
            column = column[field.dataType.names[0]]
        elif isinstance(field.dataType, T.StringType):  # a wrapped value beside plain ones comes as its JSON text
            inner = F.from_json(column, "`$oid` string, `$date` string")
            wrapped = F.regexp_like(column, F.lit(r'^\{\s*"\$(oid|date)"\s*:\s*"[^"]*"\s*\}$'))
            column = F.when(wrapped, F.coalesce(inner["$oid"], inner["$date"])).otherwise(column)
        return column.alias(field.name)

    return raw.select(*[plain(field) for field in raw.schema])


def stream_turn_log(spark: SparkSession, path: str, fmt: str = "parquet", max_bytes: int = 256 << 20) -> DataFrame:
    """The log as a stream; `max_bytes` bounds what one micro-batch takes in."""
    return spark.readStream.schema(S.TURN_LOG).format(fmt).option("maxBytesPerTrigger", max_bytes).load(path)


def articles_from_json(lists: DataFrame) -> DataFrame:
    """(article_id, text) from rows (path, value) that each hold one JSON list of objects.

    Items lacking either key are skipped, a document that is no such list gives nothing, and the last of
    several items with one id wins. Ids are written as Python's str() writes them.
    """
    items = lists.select("path", F.posexplode(F.from_json("value", "array<map<string,variant>>")).alias("pos", "item"))
    kept = items.where(F.map_contains_key("item", "article_id") & F.map_contains_key("item", "text"))
    key = F.col("item")["article_id"]
    kind, raw = F.schema_of_variant(key), key.cast("string")
    written = (
        F.when(kind == "BOOLEAN", F.initcap(raw))
        .when(F.regexp_like(kind, F.lit(r"^DECIMAL\((\d|1[0-8]),0\)$")), F.concat(raw, F.lit(".0")))
        .otherwise(F.coalesce(raw, F.lit("None")))
    )
    texts = kept.select("path", "pos", written.alias("article_id"), F.col("item")["text"].cast("string").alias("text"))
    return last_of_each(texts, ("path", "pos"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article corpus of one or more JSON files, each of them a list of objects."""
    lists = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return articles_from_json(lists)
