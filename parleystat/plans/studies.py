"""Run a study from its input files to its result tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from parleystat.operators import ols
from parleystat.operators.moments import Model, collect_moments
from parleystat.operators.survey import analysis_frame, complete_cases, condition_summary
from parleystat.plans.models import TOKENS, mediation_models, regression_models
from parleystat.session import cut_lineage
from parleystat.sources.readers import read_survey, read_utterances
from parleystat.sources.writers import write_results


@dataclass(frozen=True)
class Study:
    """Fitted models over one analysis frame, and the tables that report them."""

    frame: DataFrame
    fits: tuple[ols.Fit, ...]

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    def coefficients(self) -> DataFrame:
        return ols.coefficients(self.spark, self.fits)

    def fit_statistics(self) -> DataFrame:
        return ols.fit_statistics(self.spark, self.fits)

    def predictions(self) -> list[DataFrame]:
        """One table per fit; the tables of models with the mediator have one more column."""
        return [ols.predictions(self.frame, fit) for fit in self.fits]

    def condition_summaries(self) -> dict[str, DataFrame]:
        """The bar-chart series of each model, over the rows that model uses."""
        outcomes: dict[str, list[Model]] = {}
        for fit in self.fits:
            outcomes.setdefault(fit.model.name, []).append(fit.model)
        return {
            name: condition_summary(complete_cases(self.frame, models[0].required), [m.outcome for m in models])
            for name, models in outcomes.items()
        }

    def write(self, path: str, fmt: str = "csv") -> None:
        """Rounded coefficients and predictions, unrounded fit statistics, chart series."""
        write_results(ols.published(self.coefficients()), f"{path}/coeffs", fmt)
        write_results(self.fit_statistics(), f"{path}/fit_stats", fmt)
        for fit, table in zip(self.fits, self.predictions()):
            model = fit.model
            write_results(ols.published(table), f"{path}/predictions/{model.name}/{model.published_outcome}", fmt)
        for name, table in self.condition_summaries().items():
            writer = table.write.mode("overwrite").format(fmt)
            (writer.option("header", True) if fmt == "csv" else writer).save(f"{path}/by_condition/{name}")


def run_models(
    survey: DataFrame, utterances: DataFrame | None, models: Sequence[Model], keep_frame: bool = True, **skew: int
) -> Study:
    """Fit all models in one pass. `keep_frame` writes the frame once, for the tables that need its rows:
    the utterances are then read a single time."""
    frame = analysis_frame(survey, utterances, **skew)
    if keep_frame:
        frame = cut_lineage(frame)
    return Study(frame, tuple(ols.fit_models(frame, models)))


def needs_tokens(models: Sequence[Model]) -> bool:
    return any(TOKENS in m.required for m in models)


def sample_sizes(frame: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Rows each model uses, all from one pass."""
    moments = collect_moments(frame, models)
    sizes = {m.name: moments.sample_size(m) for m in models}
    return frame.sparkSession.createDataFrame(list(sizes.items()), "model string, n long")


def run_regression(
    spark: SparkSession, survey_path: str, conversation_path: str, out: str | None = None, spec: int = 4, fmt: str = "csv"
) -> Study:
    study = run_models(
        read_survey(spark, survey_path, fmt), read_utterances(spark, conversation_path, fmt), regression_models(spec)
    )
    if out is not None:
        study.write(out)
    return study


def run_mediation(
    spark: SparkSession, survey_path: str, conversation_path: str, out: str | None = None, fmt: str = "csv"
) -> Study:
    study = run_models(
        read_survey(spark, survey_path, fmt), read_utterances(spark, conversation_path, fmt), mediation_models()
    )
    if out is not None:
        study.write(out)
    return study
