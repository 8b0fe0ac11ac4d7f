"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parleystat.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return scratch_path(spark, f"llm-{name}")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write `frame` to the shared folder and read it back: later passes neither repeat its work nor need
    the executors that did it."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs started inside hand texts to Python in batches of at most `rows`, which bounds what a task holds of them on
    both sides. The session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs started inside go as each job ends, not when the driver happens to collect its garbage. For
    jobs that store or return their result, as nothing reads their shuffles again. The session's own setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def slices(parts: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices of at most `rows`, so that what is made of one is small. At the end the worker,
    which lives on for other tasks, gives back the memory that nothing uses."""
    for part in parts:
        for first in range(0, part.num_rows, rows):
            yield part.slice(first, rows)
        del part
    give_back()


def give_back() -> None:
    """Hand freed memory of Arrow's pool and of the C library to the system; both would keep it for this process."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that `taken` does not have."""
    return name if name not in taken else f"{name}_{uuid.uuid4().hex[:8]}"


def batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048, weigh: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Pack tuples into Arrow batches of at most `most` rows, or about 8 MB by what `weigh` says of a row."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= most or weight >= 8 << 20:
            yield to_batch(held, schema)
            held, weight = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Remembered(dict):
    """A bounded cache over `compute`: when it is full, only the entries used since the last time stay.

    It holds at most twice `limit` entries, so a worker's memory is bounded whatever it reads.
    """

    def __init__(self, compute: Callable, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def many(self, keys: list) -> list:
        """The values of distinct `keys`, none of which may be None. The cache outgrows its limit by no more than these."""
        values = list(map(self.get, keys))
        absent = [i for i, value in enumerate(values) if value is None]
        if len(self) + len(absent) > self.limit:
            self.older = dict(self)
            self.clear()
        for i in absent:
            key = keys[i]
            value = self.older.get(key)
            self[key] = values[i] = self.compute(key) if value is None else value
        return values
