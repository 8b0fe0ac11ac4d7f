"""Whitening of embeddings: principal components of their covariance, each scaled to unit variance.

Spark sums integers and centred products over all rows; only width-by-width matrices reach the driver, where `feast`
takes the leading components.

A vector is left out if it is null or empty, holds a null, NaN or infinite entry, or one whose scaled value no long
holds, or if its width is not the table's: the width that most vectors have (of equally common ones the larger).
An empty table, equal rows only, or one row alone have no components and give no rows. Repeated rows count each time
and each come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleystat.llm import feast

#: An entry c counts as the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024.0, 100_000
_LOW = 1 << 32


@dataclass(frozen=True)
class Whitening:
    """`count` rows with per-dimension `sums`; falling `values` and their unit `vectors` as columns; the `trace`."""

    count: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, whole: np.ndarray) -> np.ndarray:
        return _centred(whole, self.count, self.sums)

    def projected(self, whole: np.ndarray) -> np.ndarray:
        return self.centred(whole) @ (self.vectors / np.sqrt(self.values))


def _centred(whole: np.ndarray, count: int, sums: tuple[int, ...]) -> np.ndarray:
    """Whole numbers less their mean, the whole part of it taken off before anything is rounded."""
    parts = [divmod(s, count) for s in sums]
    return (whole - np.array([p[0] for p in parts])).astype(float) - np.array([p[1] / count for p in parts])


def whole_numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that count, and their entries as whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == width)
    entries = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), width)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * entries) + SHIFT
        held = (np.abs(scaled) < 2.0**62).all(axis=1)  # NaN, which stands for null as well, compares false
    return at[held], scaled[held].astype(np.int64)


def _of_width(vectors: DataFrame, column: str) -> int:
    """The width of most vectors that have all their entries; 0 if there are none."""
    bound = 2.0**62 / SCALE
    entry = lambda x: F.coalesce(F.abs(x.cast("double")) < bound, F.lit(False))
    complete = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, entry))
    most = complete.groupBy(F.size(column).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return most["width"] if most else 0


def _summed(vectors: DataFrame, column: str, width: int, part: Callable, schema: str, keys: list[str]) -> list:
    """Rows of `part(whole-number batches)` of every partition, summed by `keys`."""
    arrow = pa.schema([pa.field(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in schema.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = part(whole_numbers(b.column(0), width)[1] for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, arrow)], schema=arrow)

    summed = [F.sum(f.name).alias(f.name) for f in arrow if f.name not in keys]
    return vectors.select(column).mapInArrow(scan, schema).groupBy(*keys).agg(*summed).collect()


def _sums(vectors: DataFrame, column: str, width: int) -> tuple[int, tuple[int, ...]]:
    """Count and exact sums: the halves of a partition's sum add up on their own, so no sum leaves a long."""

    def part(parts):
        count, total = 0, [0] * width
        for x in parts:
            count += len(x)
            high, low = x >> 32, x & (_LOW - 1)
            total = [t + (int(a) << 32) + int(b) for t, a, b in zip(total, high.sum(axis=0), low.sum(axis=0))]
        return range(width), [count] * width, [t >> 62 for t in total], [t >> 32 & (1 << 30) - 1 for t in total], [t & _LOW - 1 for t in total]

    rows = _summed(vectors, column, width, part, "place int, rows long, top long, high long, low long", ["place"])
    sums = {r["place"]: (r["top"] << 62) + (r["high"] << 32) + r["low"] for r in rows}
    return (rows[0]["rows"], tuple(sums[k] for k in range(width))) if rows else (0, ())


def _covariance(vectors: DataFrame, column: str, width: int, count: int, sums: tuple[int, ...]) -> np.ndarray:
    """Mean product of centred entries, from the products each partition sums."""
    upper = np.triu_indices(width)

    def part(parts):
        total = np.zeros((width, width))
        for x in parts:
            c = _centred(x, count, sums)
            total += c.T @ c
        return upper[0], upper[1], total[upper]

    out = np.zeros((width, width))
    for r in _summed(vectors, column, width, part, "a int, b int, product double", ["a", "b"]):
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["product"] / count
    return out


def fit(vectors: DataFrame, column: str, components: int = 8) -> Whitening:
    """The `components` leading ones (fewer, where the covariance has fewer positive eigenvalues) over all rows."""
    width = _of_width(vectors, column)
    count, sums = _sums(vectors, column, width) if width else (0, ())
    if not count:
        return Whitening(0, (), np.empty(0), np.empty((0, 0)), 0.0)
    matrix = _covariance(vectors, column, width, count, sums)
    values, axes = feast.leading(matrix, components)
    return Whitening(count, sums, values, axes, float(np.trace(matrix)))


def identity_error(vectors: DataFrame, column: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows.

    Partitions centre by their own means, and the means are put together as pairs of groups are.
    """
    k = len(model.values)
    if not k:
        return 0.0
    a, b = np.indices((k, k)).reshape(2, -1)

    def part(parts):
        count, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for x in parts:
            if len(x):
                w = model.projected(x)
                m = w.mean(axis=0)
                step, c = m - mean, w - m
                products += c.T @ c + np.outer(step, step) * (count * len(x) / (count + len(x)))
                mean, count = mean + step * (len(x) / (count + len(x))), count + len(x)
        between = count * np.outer(mean, mean)
        return a, b, (products + between).ravel(), count * mean[a], count * mean[b]

    error, n = 0.0, model.count
    for r in _summed(vectors, column, len(model.sums), part, "a int, b int, product double, left double, right double", ["a", "b"]):
        covariance = r["product"] / n - r["left"] / n * (r["right"] / n)
        error = max(error, abs(covariance - (r["a"] == r["b"])))
    return error


def deviations(whole: np.ndarray, count: int, sums: tuple[int, ...]) -> pa.Array:
    """Per row the sum of (count * x - sum) squared, exact; null where no long holds it."""
    top = float(np.abs(whole).max(initial=0)) * count + max(map(abs, sums), default=0)
    if top < 2.0**62:
        off = whole * count - np.array(sums, np.int64)
        if float((off.astype(float) ** 2).sum(axis=1).max(initial=0.0)) < 2.0**62:
            return pa.array((off * off).sum(axis=1), pa.int64())
    exact = [sum((int(x) * count - s) ** 2 for x, s in zip(row, sums)) for row in whole]
    return pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())


def whiten(vectors: DataFrame, id_column: str, column: str, model: Whitening) -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained`: a row per vector that counts and component."""
    k, width = len(model.values), len(model.sums)
    schema = pa.schema(
        [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64())]
    )
    number = pa.array(np.arange(1, k + 1), pa.int32())

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, whole = whole_numbers(part.column(1), width)
            if not k or not len(at):
                continue
            again = pa.array(np.repeat(np.arange(len(at)), k))
            columns = [
                part.column(0).take(pa.array(at)).take(again),
                number.take(pa.array(np.tile(np.arange(k), len(at)))),
                pa.array(np.full(len(at) * k, model.count), pa.int64()),
                deviations(whole, model.count, model.sums).take(again),
                pa.array(model.projected(whole).ravel()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column)).mapInArrow(
        scan, "vec_id long, component int, n long, deviation long, whitened double"
    )
    share = (model.values / model.trace).tolist() if k else [0.0]
    return rows.withColumn("explained", F.element_at(F.array(*map(F.lit, share)), F.col("component")))
