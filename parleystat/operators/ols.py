"""Ordinary least squares from sufficient statistics: coefficients, fit statistics, predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache, reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.functions.scores import round_half_even, significance
from parleystat.operators.moments import Model, Moments, Term, collect_moments
from parleystat.operators.survey import complete_cases

# Below this share of unexplained variance the one-pass residual sum has lost too many digits.
_CANCELLATION = 1e-7


@dataclass(frozen=True)
class Fit:
    model: Model
    terms: tuple[Term, ...]
    beta: np.ndarray
    std: np.ndarray
    t: np.ndarray
    p: np.ndarray
    n: int
    rank: int
    r_squared: float
    adj_r_squared: float
    aic: float
    bic: float

    def predicted(self) -> Column:
        """The fitted value as a plain column expression."""
        parts = []
        for term, value in zip(self.terms, self.beta):
            weight = F.lit(float(value))
            if term.column is None:
                parts.append(weight)
            elif term.level is None:
                parts.append(weight * F.col(f"`{term.column}`"))
            else:
                parts.append(F.when(F.col(f"`{term.column}`") == term.level, weight).otherwise(0.0))
        return reduce(add, parts)


@cache
def _quadrature() -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(200)


def two_sided_p(t: float, df: int) -> float:
    """Student's t tail on both sides, as a ratio of integrals of cos^(df-1), by Gauss-Legendre."""
    if df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    nodes, weights = _quadrature()
    reach = 12.0 / math.sqrt(df)

    def area(start: float) -> tuple[float, float]:
        # log of cos^(df-1) at `start`, and the integral from there relative to it
        end = min(math.pi / 2, start + reach)
        x = (end - start) / 2 * (nodes + 1) + start
        peak = (df - 1) * math.log(max(math.cos(start), 1e-300))
        tail = np.exp((df - 1) * np.log(np.maximum(np.cos(x), 1e-300)) - peak)
        return peak, float((end - start) / 2 * np.dot(weights, tail))

    peak, upper = area(math.atan(abs(t) / math.sqrt(df)))
    return min(1.0, math.exp(peak) * upper / area(0.0)[1])


def solve(model: Model, moments: Moments, frame: DataFrame | None = None) -> Fit:
    """Solve the normal equations. `frame` is read again only where the fit is nearly perfect and the
    residual sum must be taken from the residuals themselves."""
    g = moments.gram(model)
    xx, xy = np.asarray(g.xx, float), np.asarray(g.xy, float)
    scale = np.sqrt(np.maximum(np.diag(xx), 0.0))
    # A centred column whose spread is rounding error of its mean is constant.
    constant = scale <= 1e-13 * np.abs(np.asarray(g.means, float)) * math.sqrt(g.n)
    scale[constant | (scale == 0)] = math.inf
    scaled = np.where(np.isinf(np.add.outer(scale, scale)), 0.0, xx / np.outer(scale, scale))
    rank = int(np.linalg.matrix_rank(scaled, tol=1e-11 * len(scale), hermitian=True))
    back = np.eye(len(scale))  # from the centred columns' coefficients to those of the columns as they are
    back[0] -= np.asarray(g.means, float)
    if rank == len(scale):
        inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
        centred = inverse @ xy
        centred = centred + inverse @ np.asarray(g.xy - g.xx @ centred, float)
        beta = back @ centred
        beta[0] += g.y_mean
        inverse = back @ inverse @ back.T
        wide = centred.astype(np.longdouble)
    else:
        # Solve where the columns are centred and scaled, and find there which combinations of columns vanish. Of all
        # solutions the shortest in the columns' own units is the one without a part along those combinations.
        unit = np.where(np.isinf(scale), 1.0, scale)
        size, axes = np.linalg.eigh(scaled)
        held, lost = axes[:, len(scale) - rank :], axes[:, : len(scale) - rank]
        # Columns that take no part but for rounding: times a large mean that would not stay small.
        lost = np.where(np.linalg.norm(lost, axis=1, keepdims=True) < 1e-7, 0.0, lost)
        inverse = (held / size[len(scale) - rank :]) @ held.T / np.outer(unit, unit)
        centred = inverse @ xy
        centred = centred + inverse @ np.asarray(g.xy - g.xx @ centred, float)
        vanishing, _ = np.linalg.qr(back @ (lost / unit[:, None]))
        shortest = np.eye(len(scale)) - vanishing @ vanishing.T
        beta = back @ centred
        beta[0] += g.y_mean
        beta = shortest @ beta
        inverse = shortest @ back @ inverse @ back.T @ shortest
        wide = centred.astype(np.longdouble)
    ssr = max(float(np.longdouble(g.yy) - 2 * wide @ g.xy + wide @ g.xx @ wide), 0.0)
    sst = g.yy
    df = g.n - rank
    fit = _finish(model, g.terms, beta, inverse, ssr, sst, g.n, rank, df)
    if frame is not None and ssr < _CANCELLATION * abs(sst):
        gap = F.col(f"`{model.outcome}`") - fit.predicted()
        ssr = complete_cases(frame, model.required).agg(F.sum(gap * gap)).first()[0]
        fit = _finish(model, g.terms, beta, inverse, ssr, sst, g.n, rank, df)
    return fit


def _finish(
    model: Model,
    terms: tuple[Term, ...],
    beta: np.ndarray,
    inverse: np.ndarray,
    ssr: float,
    sst: float,
    n: int,
    rank: int,
    df: int,
) -> Fit:
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = ssr / df if df > 0 else math.nan
        std = np.sqrt(variance * np.maximum(np.diag(inverse), 0.0))
        t = beta / std
        r_squared = float(1 - np.float64(ssr) / sst)
        adjusted = 1 - (n - 1) / df * (1 - r_squared) if df > 0 else math.nan
        log_likelihood = float(-n / 2 * (np.log(2 * math.pi * np.float64(ssr) / n) + 1))
    p = np.array([two_sided_p(float(value), df) for value in t])
    return Fit(
        model, terms, beta, std, t, p, n, rank, r_squared, adjusted,
        -2 * log_likelihood + 2 * rank, -2 * log_likelihood + rank * math.log(n),
    )


def fit_models(frame: DataFrame, models: Sequence[Model]) -> list[Fit]:
    """Fit all models from one pass over the frame."""
    moments = collect_moments(frame, models)
    return [solve(model, moments, frame) for model in models]


def coefficients(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """One row per model and term, unrounded."""
    rows = [
        (f.model.name, f.model.published_outcome, term.name, float(b), float(s), float(t), float(p))
        for f in fits
        for term, b, s, t, p in zip(f.terms, f.beta, f.std, f.t, f.p)
    ]
    table = spark.createDataFrame(
        rows, "model string, outcome string, term string, coefficients double, std double, t double, `p-value` double"
    )
    return table.withColumn("Significance", significance(F.col("`p-value`")))


def fit_statistics(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    rows = [
        (f.model.name, f.model.published_outcome, f.n, f.r_squared, f.adj_r_squared, f.aic, f.bic) for f in fits
    ]
    return spark.createDataFrame(
        rows,
        "model string, outcome string, n long, r_squared double, adj_r_squared double, aic double, bic double",
    )


def mediation_effects(spark: SparkSession, fits: Sequence[Fit], treatment: str, mediator: str) -> DataFrame:
    """Per outcome: the total effect c, the paths a and b, the direct effect c', the indirect effect a*b and its z
    (Sobel). c = c' + a*b holds only where the three models share one sample."""

    def effect(fit: Fit, column: str) -> tuple[float, float]:
        place = next(i for i, t in enumerate(fit.terms) if t.column == column and t.level is None)
        return float(fit.beta[place]), float(fit.std[place])

    def is_full(fit: Fit) -> bool:
        return mediator in fit.model.numeric

    a, a_std = next(effect(f, treatment) for f in fits if f.model.outcome == mediator)
    totals = {f.model.published_outcome: effect(f, treatment)[0] for f in fits if f.model.outcome != mediator and not is_full(f)}
    rows = []
    for fit in filter(is_full, fits):
        b, b_std = effect(fit, mediator)
        spread = math.sqrt(b * b * a_std * a_std + a * a * b_std * b_std)
        z = a * b / spread if spread > 0 else math.nan
        outcome = fit.model.published_outcome
        rows.append((outcome, totals[outcome], a, b, effect(fit, treatment)[0], a * b, z))
    schema = "outcome string, total double, path_a double, path_b double, direct double, indirect double, sobel_z double"
    return spark.createDataFrame(rows, schema)


def predictions(frame: DataFrame, fit: Fit) -> DataFrame:
    """Actual, fitted and residual value of every row of the model's sample, unrounded. The tokens are
    listed wherever the frame has them, whether or not the model uses them."""
    actual = F.col(f"`{fit.model.outcome}`").cast("double")
    mediator = ["anthropomorphism_score"] if "anthropomorphism_score" in fit.model.numeric else []
    return complete_cases(frame, fit.model.required).select(
        F.lit(fit.model.name).alias("model"),
        F.lit(fit.model.published_outcome).alias("outcome"),
        "person_id",
        actual.alias("actual"),
        fit.predicted().alias("predicted"),
        (actual - fit.predicted()).alias("residual"),
        "condition",
        "condition_avatar",
        *mediator,
        *[name for name in ("total_tokens",) if name in frame.columns],
        S.SEX,
        f"`{S.ETHNICITY}`",
        "extraversion_score",
        "agreeableness_score",
    )


_ROUNDED = (
    "actual", "predicted", "residual", "anthropomorphism_score", "total_tokens",
    "extraversion_score", "agreeableness_score", "coefficients", "std", "t", "p-value",
)


def published(table: DataFrame) -> DataFrame:
    """Round the numeric columns of a prediction or coefficient table to four digits."""
    present = [name for name in _ROUNDED if name in table.columns]
    return table.withColumns({name: round_half_even(F.col(f"`{name}`")) for name in present})


def identity_line(predicted: DataFrame) -> DataFrame:
    """Ends of the 45-degree line of each actual-versus-predicted chart."""
    return predicted.groupBy("model", "outcome").agg(
        F.least(F.min("actual"), F.min("predicted")).alias("low"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("high"),
    )
