"""Survey scores, indicators and published-table formatting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from parleystat import schemas as S


def mean_of_present(names: Sequence[str]) -> Column:
    """Row-wise mean that skips missing items; missing when every item is."""
    total = reduce(add, [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    present = reduce(add, [F.col(n).isNotNull().cast("int") for n in names])
    return total / F.nullif(present, F.lit(0))


def keyed_mean(plus: Sequence[str], minus: Sequence[str]) -> Column:
    """Mean of positively and reverse-keyed items; one missing item makes the score missing."""
    signed = [F.col(n) for n in plus] + [-F.col(n) for n in minus]
    return reduce(add, signed).cast("double") / F.lit(float(len(signed)))


def empathy_mean() -> Column:
    return mean_of_present(S.EMPATHY_ITEMS)


def anthropomorphism() -> Column:
    return mean_of_present(S.ANTHRO_ITEMS)


def extraversion() -> Column:
    return keyed_mean(S.EXTRAVERSION_PLUS, S.EXTRAVERSION_MINUS)


def agreeableness() -> Column:
    return keyed_mean(S.AGREEABLENESS_PLUS, S.AGREEABLENESS_MINUS)


def is_avatar(condition: Column) -> Column:
    return condition.isin(*S.AVATAR_CONDITIONS).cast("int")


def significance(p_value: Column) -> Column:
    """One star below .05, two below .10 (the study's own convention), else 'ns'; NaN is 'ns'."""
    return F.when(p_value < 0.05, "*").when(p_value < 0.1, "**").otherwise("ns")


def round_half_even(value: Column, digits: int = 4) -> Column:
    """Rounding on the binary value, as numpy does it: scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale
