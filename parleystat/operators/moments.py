"""Sufficient statistics for linear models, from one pass over the analysis frame.

Rows are grouped by which models' samples they belong to and by all categories, once; each group keeps its row count
and the means and covariances of the numeric columns, which merge without loss of digits. From these finest groups come
those by sample alone, with each category and with each pair of categories, so no row is read or copied for more than one. Every design matrix that mixes those columns has its centred X'X and X'y as
sums over these groups, so one aggregation with map-side combining serves all models at once, and the
category levels come with it. The result is no larger than the squared width of the design.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, combinations_with_replacement
from operator import and_, or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleystat.session import cut_lineage


@dataclass(frozen=True)
class Model:
    """outcome ~ intercept + treatment-coded categories + numeric terms, over the complete cases."""

    name: str
    outcome: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    required: tuple[str, ...]
    label: str | None = None

    @property
    def published_outcome(self) -> str:
        return self.label or self.outcome


@dataclass(frozen=True)
class Term:
    """A design column: the intercept, a numeric column, or one level of a category."""

    name: str
    column: str | None = None
    level: str | None = None


@dataclass(frozen=True)
class Gram:
    """X'X, X'y and y'y of one model with its numeric columns and the outcome centred at their means (a term's
    mean is 0 where it is not centred), and the row count."""

    terms: tuple[Term, ...]
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: int
    means: np.ndarray
    y_mean: float

    def shift(self) -> np.ndarray:
        """The columns as they are, in terms of the centred ones: a column plus its mean times the intercept."""
        shift = np.eye(len(self.terms), dtype=np.longdouble)
        shift[0] += self.means
        return shift

    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        """X'X and X'y of the columns as they are."""
        shift = self.shift()
        return shift.T @ self.xx @ shift, shift.T @ (self.xy + self.y_mean * self.xx[:, 0])


def indicator_name(column: str, level: str) -> str:
    quoted = column if column.isidentifier() else f"Q('{column}')"
    return f"C({quoted})[T.{level}]"


def in_order(levels: set[str]) -> list[str]:
    """Levels that are all numbers sort as numbers, others as text."""
    try:
        return sorted(levels, key=float)
    except ValueError:
        return sorted(levels)


@dataclass(frozen=True)
class Moments:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    samples: tuple[tuple[str, ...], ...]
    cells: list[dict]

    def _cells(self, model: Model, *columns: str) -> list[dict]:
        """The groups of the model's sample by these categories."""
        flag = f"_in{self.samples.index(model.required)}"
        kept = {c: c in columns for c in self.categorical}
        return [x for x in self.cells if x[flag] and all((x[f"_out_{c}"] == 0) == k for c, k in kept.items())]

    def sample_size(self, model: Model) -> int:
        return sum(cell["_n"] for cell in self._cells(model))

    def terms(self, model: Model) -> tuple[Term, ...]:
        """Intercept, then the categories (first level of the sample is the reference), then numerics."""
        terms = [Term("Intercept")]
        for column in model.categorical:
            levels = in_order({cell[column] for cell in self._cells(model, column)})
            terms += [Term(indicator_name(column, level), column, level) for level in levels[1:]]
        terms += [Term(column, column) for column in model.numeric]
        return tuple(terms)

    def gram(self, model: Model) -> Gram:
        cells = self._cells(model)
        if not cells:
            raise ValueError(f"model {model.name} has no complete rows")
        terms = self.terms(model)
        place = {name: i for i, name in enumerate(self.numeric)}
        used = [place[c] for c in (*model.numeric, model.outcome)]  # the outcome last
        p, q = len(terms), len(used)
        level = {(t.column, t.level): i for i, t in enumerate(terms) if t.level is not None}

        def means_of(cell: dict) -> np.ndarray:
            return np.array([cell[f"_m{i}"] for i in used], np.longdouble)

        n = sum(cell["_n"] for cell in cells)
        centre = sum(cell["_n"] * means_of(cell) for cell in cells) / n
        # One more column than terms: the outcome's.
        whole = np.zeros((p + 1, p + 1), np.longdouble)
        moving = [*range(p + 1 - q, p), p]
        whole[0, 0] = n
        for cell in cells:
            gap = means_of(cell) - centre
            spread = np.array([[cell[f"_c{min(i, j)}_{max(i, j)}"] for j in used] for i in used], np.longdouble)
            whole[np.ix_(moving, moving)] += cell["_n"] * (spread + np.outer(gap, gap))
        for column in model.categorical:
            for cell in self._cells(model, column):
                i = level.get((column, cell[column]))
                if i is not None:
                    whole[i, i] += cell["_n"]
                    whole[0, i] = whole[i, 0] = whole[i, i]
                    whole[i, moving] += cell["_n"] * (means_of(cell) - centre)
                    whole[moving, i] = whole[i, moving]
        for a, b in combinations(model.categorical, 2):
            for cell in self._cells(model, a, b):
                i, j = level.get((a, cell[a])), level.get((b, cell[b]))
                if i is not None and j is not None:
                    whole[i, j] += cell["_n"]
                    whole[j, i] = whole[i, j]
        means = np.zeros(p, np.longdouble)
        means[p + 1 - q :] = centre[:-1]
        return Gram(terms, whole[:p, :p], whole[:p, p], float(whole[p, p]), n, means, float(centre[-1]))


def collect_moments(frame: DataFrame, models: Sequence[Model]) -> Moments:
    """Run the one aggregation."""
    numeric = tuple(dict.fromkeys(c for m in models for c in (*m.numeric, m.outcome)))
    categorical = tuple(dict.fromkeys(c for m in models for c in m.categorical))
    samples = tuple(dict.fromkeys(m.required for m in models))
    complete = {
        f"_in{i}": reduce(and_, [F.col(f"`{c}`").isNotNull() for c in needed])
        for i, needed in enumerate(samples)
    }
    values = [F.col(c).cast("double") for c in numeric]
    pairs = list(combinations_with_replacement(range(len(numeric)), 2))
    flags = [F.col(name) for name in complete]
    named = {c: F.col(f"`{c}`") for c in categorical}
    by = [(), *[(c,) for c in categorical], *combinations(categorical, 2)]
    cells = (
        frame.withColumns(complete)
        .where(reduce(or_, flags))
        .groupBy(*flags, *named.values())
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.avg(v).alias(f"_m{i}") for i, v in enumerate(values)],
            *[F.covar_pop(values[i], values[j]).alias(f"_c{i}_{j}") for i, j in pairs],
        )
    )
    merged = _merged_here if len(categorical) <= 2 else _merged_there
    return Moments(numeric, categorical, samples, merged(cells, by, list(complete), categorical, len(numeric), pairs))


def _merged_here(
    cells: DataFrame, by: list[tuple], flags: list[str], categorical: tuple[str, ...], count: int, pairs: list[tuple[int, int]]
) -> list[dict]:
    """The groups of every set, put together from the finest ones, which with up to two categories are themselves a
    set and no more than the result."""
    finest = [r.asDict() for r in cells.collect()]
    number = lambda x: np.longdouble(np.nan if x is None else x)
    out = []
    for some in by:
        groups: dict[tuple, list[dict]] = {}
        for cell in finest:
            groups.setdefault(tuple(cell[n] for n in (*flags, *some)), []).append(cell)
        for key, held in groups.items():
            weights = np.array([c["_n"] for c in held], np.longdouble)
            total = weights.sum()
            means = np.array([[number(c[f"_m{i}"]) for i in range(count)] for c in held], np.longdouble).reshape(len(held), count)
            centre = weights @ means / total
            gaps = means - centre
            group = dict(zip((*flags, *some), key)) | {"_n": int(total)} | {f"_out_{c}": int(c not in some) for c in categorical}
            group |= {f"_m{i}": centre[i] for i in range(count)}
            for i, j in pairs:
                spread = np.array([number(c[f"_c{i}_{j}"]) for c in held], np.longdouble)
                group[f"_c{i}_{j}"] = weights @ (spread + gaps[:, i] * gaps[:, j]) / total
            out.append(group)
    return out


def _merged_there(
    cells: DataFrame, by: list[tuple], flags: list[str], categorical: tuple[str, ...], count: int, pairs: list[tuple[int, int]]
) -> list[dict]:
    """The groups of every set, put together by Spark: with more categories the finest groups may be many. Means are
    taken from a common place, so that large ones cost no digits."""
    cells = cut_lineage(cells, "cells")
    middle = cells.agg(*[F.coalesce(F.avg(f"_m{i}"), F.lit(0.0)) for i in range(count)]).first() if count else ()
    n, total = F.col("_n"), F.sum("_n")
    gap = [F.col(f"_m{i}") - m for i, m in enumerate(middle)]
    shift = [F.sum(n * g) / total for g in gap]
    grouped = cells.groupingSets([[F.col(f"`{c}`") for c in (*flags, *some)] for some in by], *[F.col(f"`{c}`") for c in (*flags, *categorical)]).agg(
        total.alias("_total"),
        *[F.grouping(F.col(f"`{c}`")).alias(f"_out_{c}") for c in categorical],
        *[(shift[i] + m).alias(f"_mean{i}") for i, m in enumerate(middle)],
        *[(F.sum(n * (F.col(f"_c{i}_{j}") + gap[i] * gap[j])) / total - shift[i] * shift[j]).alias(f"_c{i}_{j}") for i, j in pairs],
    )
    names = {"_total": "_n"} | {f"_mean{i}": f"_m{i}" for i in range(count)}
    return [{names.get(k, k): v for k, v in r.asDict().items()} for r in grouped.collect()]
