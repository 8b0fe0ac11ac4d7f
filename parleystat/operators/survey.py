"""The analysis frame: scored survey, token totals, condition filter, complete cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.functions import scores
from parleystat.functions.text import count_tokens
from parleystat.operators.skew import heavy_keys, lookup_join


def token_totals(utterances: DataFrame) -> DataFrame:
    """Tokens per person over both sides of the talk; utterances of nobody are dropped."""
    return (
        utterances.where(F.col("person_id").isNotNull())
        .select("person_id", count_tokens(F.col("text")).alias("token_count"))
        .groupBy("person_id")
        .agg(F.sum("token_count").alias("total_tokens"))
    )


def with_scores(survey: DataFrame) -> DataFrame:
    return survey.withColumns(
        {
            "EMP_Mean": scores.empathy_mean(),
            "anthropomorphism_score": scores.anthropomorphism(),
            "extraversion_score": scores.extraversion(),
            "agreeableness_score": scores.agreeableness(),
        }
    )


def core_conditions(survey: DataFrame) -> DataFrame:
    """Keep the three core conditions and flag the avatar ones."""
    kept = survey.where(F.col("condition").isin(*S.CORE_CONDITIONS))
    return kept.withColumn("condition_avatar", scores.is_avatar(F.col("condition")))


_FRAME = (
    "person_id", "condition", "condition_avatar", S.SEX, S.ETHNICITY, "EMP_1", "EMP_Mean",
    "anthropomorphism_score", "extraversion_score", "agreeableness_score",
)


def analysis_frame(survey: DataFrame, utterances: DataFrame | None, **skew: int) -> DataFrame:
    """One row per survey row of the core conditions. Without `utterances` the text is never read and
    there is no `total_tokens` column."""
    scored = core_conditions(with_scores(survey)).select(*_FRAME)
    if utterances is None:
        return scored
    # Filtering can only thin a key out, so the unfiltered survey, counted from file footers, will do.
    return lookup_join(scored, token_totals(utterances), heavy_keys(survey, "person_id", **skew))


def complete_cases(frame: DataFrame, required: Sequence[str]) -> DataFrame:
    return frame.dropna(how="any", subset=list(required))


def condition_summary(frame: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Bar-chart series: mean, sample deviation, count and standard error per condition and outcome,
    with the ends of the axis. A condition with a single answer has no deviation and is dropped."""
    stats = frame.groupBy("condition").agg(
        *[
            F.struct(
                F.lit(name).alias("outcome"),
                F.avg(name).alias("mean"),
                F.stddev_samp(name).alias("std"),
                F.count(name).alias("count"),
                F.lit(0).alias("axis_min"),
                F.lit(5 if name == "anthropomorphism_score" else 7).alias("axis_max"),
            ).alias(name)
            for name in outcomes
        ]
    )
    rows = stats.select("condition", F.inline(F.array(*[F.col(name) for name in outcomes])))
    return rows.dropna().withColumn("sem", F.col("std") / F.sqrt(F.col("count")))
