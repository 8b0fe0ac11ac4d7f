"""Survey frames and regression against numpy, pyspark.ml and hand-worked cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.operators import ols, survey
from parleystat.operators.moments import Model, collect_moments, in_order
from parleystat.plans import proxies
from parleystat.plans.models import mediation_models, regression_models
from parleystat.plans.studies import run_models

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def frame(spark):
    return survey.analysis_frame(proxies.survey(spark, FOLDER), proxies.utterances(spark, FOLDER)).persist()


def design(rows, model):
    """Design matrix and outcome built the long way round."""
    columns = [("Intercept", [1.0] * len(rows))]
    for name in model.categorical:
        for level in sorted({r[name] for r in rows})[1:]:
            quoted = name if " " not in name else f"Q('{name}')"
            columns.append((f"C({quoted})[T.{level}]", [float(r[name] == level) for r in rows]))
    columns += [(name, [float(r[name]) for r in rows]) for name in model.numeric]
    return [c[0] for c in columns], np.array([c[1] for c in columns]).T, np.array([float(r[model.outcome]) for r in rows])


ALL = [m for spec in (1, 2, 3, 4) for m in regression_models(spec)] + mediation_models()


def test_all_models_from_one_pass(frame):
    for fit in ols.fit_models(frame, ALL):
        rows = [r for r in frame.collect() if all(r[c] is not None for c in fit.model.required)]
        names, x, y = design(rows, fit.model)
        assert [t.name for t in fit.terms] == names
        beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        residual = y - x @ beta
        df = len(y) - rank
        std = np.sqrt(residual @ residual / df * np.diag(np.linalg.inv(x.T @ x)))
        np.testing.assert_allclose(fit.beta, beta, rtol=1e-8, atol=1e-10)
        np.testing.assert_allclose(fit.std, std, rtol=1e-8)
        r2 = 1 - residual @ residual / ((y - y.mean()) @ (y - y.mean()))
        llf = -len(y) / 2 * (math.log(2 * math.pi * (residual @ residual) / len(y)) + 1)
        np.testing.assert_allclose(
            [fit.n, fit.rank, fit.r_squared, fit.adj_r_squared, fit.aic, fit.bic],
            [len(y), rank, r2, 1 - (len(y) - 1) / df * (1 - r2), -2 * llf + 2 * rank, -2 * llf + rank * math.log(len(y))],
            rtol=1e-9, atol=1e-12,
        )


def test_agrees_with_spark_ml(frame):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    model = regression_models(4)[0]
    fit = ols.fit_models(frame, [model])[0]
    sample = survey.complete_cases(frame, model.required)
    columns = []
    for i, term in enumerate(fit.terms[1:]):
        value = F.col(f"`{term.column}`")
        value = (value == term.level).cast("double") if term.level else value.cast("double")
        sample = sample.withColumn(f"x{i}", value)
        columns.append(f"x{i}")
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(sample)
    fitted = LinearRegression(solver="normal", labelCol="EMP_Mean").fit(ready)
    np.testing.assert_allclose(fit.beta[1:], fitted.coefficients.toArray(), rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(fit.p[1:], fitted.summary.pValues[:-1], rtol=1e-6)
    np.testing.assert_allclose(fit.std[1:], fitted.summary.coefficientStandardErrors[:-1], rtol=1e-6)


def test_residuals_are_orthogonal(frame):
    model = regression_models(4)[0]
    table = ols.predictions(frame, ols.fit_models(frame, [model])[0])
    sums = table.agg(
        F.sum("residual").alias("a"), F.sum(F.col("residual") * F.col("total_tokens")).alias("b"),
        F.sum(F.when(F.col("Sex") == "Male", F.col("residual"))).alias("c"),
    ).first()
    assert max(abs(v) for v in sums) < 1e-6


def test_prediction_columns(frame):
    path = ols.predictions(frame, ols.fit_models(frame, [m for m in mediation_models() if m.name == "full_outcome"])[0])
    assert path.columns == [
        "model", "outcome", "person_id", "actual", "predicted", "residual", "condition", "condition_avatar",
        "anthropomorphism_score", "total_tokens", S.SEX, S.ETHNICITY, "extraversion_score", "agreeableness_score",
    ]


@pytest.mark.parametrize(
    ("t", "df", "p"),
    [
        (0.0, 5, 1.0), (1.0, 1, 0.5), (math.sqrt(2), 2, 1 - math.sqrt(2) / 2), (-1.0, 1, 0.5),
        (1.959963984540054, 10**9, 0.05), (2.5758293035489004, 10**9, 0.01), (math.inf, 7, 0.0),
    ],
)
def test_student_tail(t, df, p):
    assert ols.two_sided_p(t, df) == pytest.approx(p, abs=1e-8)


def test_student_tail_far_out():
    # Closed form for two degrees of freedom.
    for t in (3.0, 30.0, 3000.0):
        closed = 2 / (t * t + 2) / (1 + t / math.sqrt(t * t + 2))
        assert ols.two_sided_p(t, 2) == pytest.approx(closed, rel=1e-6)
    assert math.isnan(ols.two_sided_p(1.0, 0)) and math.isnan(ols.two_sided_p(math.nan, 5))


def small(spark, rows):
    return spark.createDataFrame(rows, "y double, x double, z double, g string")


def test_perfect_fit_takes_residuals_from_the_rows(spark):
    frame = small(spark, [(1e6 + 3.0 * i + (1e-4 if i % 2 else -1e-4), float(i), 0.0, "a") for i in range(200)])
    fit = ols.fit_models(frame, [Model("m", "y", ("x",), (), ("y", "x"))])[0]
    assert fit.std[1] == pytest.approx(1e-4 / math.sqrt(198) / math.sqrt(np.var(range(200))), rel=1e-2)


def test_rank_deficient_design_gives_the_shortest_solution(spark):
    rows = [(2.0 * i + (i % 3), float(i), 2.0 * i, "a") for i in range(30)]
    fit = ols.fit_models(small(spark, rows), [Model("m", "y", ("x", "z"), (), ("y", "x", "z"))])[0]
    x = np.array([[1.0, r[1], r[2]] for r in rows])
    np.testing.assert_allclose(fit.beta, np.linalg.pinv(x) @ np.array([r[0] for r in rows]), atol=1e-6)
    assert fit.rank == 2


@pytest.mark.parametrize("mean", [0.0, 1e3, 1e6])
@pytest.mark.parametrize("kind", ["indicator again", "ones", "large constant", "line through x"])
def test_collinear_columns_of_any_mean(spark, mean, kind):
    """The shortest solution of the design as it is, its errors and its fit, from extended-precision residuals."""
    rng = np.random.default_rng(3)
    n = 500
    g = rng.integers(0, 2, n)
    x = np.round(rng.normal(size=n), 3) + mean
    y = np.round(2 * (x - mean) + g + rng.normal(size=n), 3)
    z = {"indicator again": g * 1.0, "ones": np.ones(n), "large constant": np.full(n, 1e6), "line through x": 3 * x + 7}[kind]
    rows = [(float(c), float(a), float(b), "ab"[k]) for a, b, c, k in zip(x, z, y, g)]
    fit = ols.fit_models(small(spark, rows), [Model("m", "y", ("x", "z"), ("g",), ("y", "x", "z", "g"))])[0]
    assert [t.name for t in fit.terms] == ["Intercept", "C(g)[T.b]", "x", "z"] and fit.rank == 3
    # Without z the design is regular, and z is a known combination of its columns.
    part = {"indicator again": [0, 1, 0], "ones": [1, 0, 0], "large constant": [1e6, 0, 0], "line through x": [7, 0, 3]}[kind]
    xc, gc, yc = (x - mean) - (x - mean).mean(), g - g.mean(), y - y.mean()
    two = np.stack([gc, xc], axis=1)
    slopes = np.linalg.solve(two.T @ two, two.T @ yc)
    ssr = ((yc - two @ slopes) ** 2).sum()
    regular = np.array([y.mean() - slopes @ [g.mean(), x.mean()], *slopes, 0.0])
    inverse = np.zeros((4, 4))
    inverse[1:3, 1:3] = np.linalg.inv(two.T @ two)
    inverse[0, 1:3] = inverse[1:3, 0] = -inverse[1:3, 1:3] @ [g.mean(), x.mean()]
    inverse[0, 0] = 1 / n - inverse[0, 1:3] @ [g.mean(), x.mean()]
    away = np.array([*part, -1.0])
    keep = np.eye(4) - np.outer(away, away) / (away @ away)
    np.testing.assert_allclose(fit.beta, keep @ regular, rtol=1e-5, atol=1e-8 * max(1, mean))
    std = np.sqrt(np.diag(keep @ inverse @ keep) * ssr / (n - 3))
    np.testing.assert_allclose(fit.std, std, rtol=1e-5, atol=1e-12 * max(1, mean))
    assert fit.r_squared == pytest.approx(1 - ssr / (yc @ yc), rel=1e-8)


def test_reference_level_comes_from_the_sample(spark):
    rows = [(None, 1.0, 0.0, "a")] + [(float(i % 5), float(i), 0.0, "bc"[i % 2]) for i in range(20)]
    fit = ols.fit_models(small(spark, rows), [Model("m", "y", ("x",), ("g",), ("y", "x", "g"))])[0]
    assert [t.name for t in fit.terms] == ["Intercept", "C(g)[T.c]", "x"]


def test_numeric_levels_sort_as_numbers():
    assert in_order({"10", "9", "2"}) == ["2", "9", "10"]
    assert in_order({"10", "9", "x"}) == ["10", "9", "x"]


def test_many_levels(spark):
    rows = [(float(i * i % 17), float(i % 11), 0.0, f"g{i % 260}") for i in range(2600)]
    model = Model("m", "y", ("x",), ("g",), ("y", "x", "g"))
    fit = ols.fit_models(small(spark, rows), [model])[0]
    assert len(fit.terms) == 261 and fit.rank == 261
    x = np.array([[1.0, *[float(r[3] == t.level) for t in fit.terms[1:-1]], r[1]] for r in rows])
    np.testing.assert_allclose(fit.beta, np.linalg.lstsq(x, np.array([r[0] for r in rows]), rcond=None)[0], atol=1e-7)


def test_no_rows(spark):
    with pytest.raises(ValueError, match="no complete rows"):
        ols.fit_models(small(spark, [(None, 1.0, 1.0, "a")]), [Model("m", "y", ("x",), ("g",), ("y", "x", "g"))])


@pytest.mark.parametrize("x_mean, y_mean", [(1e6, 0.0), (1.7e9, 0.0), (0.0, 1e6), (0.0, 1e8), (0.0, 1e9), (1e6, 1e8)])
def test_large_means(spark, x_mean, y_mean):
    """Exact centring in plain numpy against the fit on the shifted columns."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=500), 4)
    y = np.round(2 * x + rng.normal(size=500), 4)
    x, y = x + x_mean, y + y_mean
    rows = [(float(b), float(a), 0.0, "c") for a, b in zip(x, y)]
    fit = ols.fit_models(small(spark, rows), [Model("m", "y", ("x",), (), ("y", "x"))])[0]
    xc, yc = (x - x_mean) - (x - x_mean).mean(), (y - y_mean) - (y - y_mean).mean()
    slope = xc @ yc / (xc @ xc)
    ssr = ((yc - slope * xc) ** 2).sum()
    assert fit.rank == 2
    assert fit.beta[1] == pytest.approx(slope, rel=1e-6)
    assert fit.std[1] == pytest.approx(np.sqrt(ssr / 498 / (xc @ xc)), rel=1e-6)
    assert fit.r_squared == pytest.approx(1 - ssr / (yc @ yc), rel=1e-6)


def test_unknown_spec():
    with pytest.raises(ValueError):
        regression_models(5)


def test_spec_one_slope_is_the_difference_of_means(frame):
    fit = ols.fit_models(frame, regression_models(1)[:1])[0]
    sample = survey.complete_cases(frame, fit.model.required)
    means = {r["condition_avatar"]: r["m"] for r in sample.groupBy("condition_avatar").agg(F.avg("EMP_Mean").alias("m")).collect()}
    assert fit.beta[1] == pytest.approx(means[1] - means[0])


def test_frame_keeps_duplicates_and_drops_other_conditions(spark):
    people = [("1", "text"), ("1", "text"), (None, "text"), ("2", "other"), ("3", "Text"), ("4", None), ("5", "male_avatar")]
    items = [f for f in S.SURVEY.names if f not in ("person_id", "condition", S.SEX, S.ETHNICITY)]
    rows = [(p, c, "F", "e", *[1.0] * len(items)) for p, c in people]
    answers = spark.createDataFrame(rows, ["person_id", "condition", S.SEX, S.ETHNICITY, *items])
    said = spark.createDataFrame([("1", "a b"), ("1", None), ("1", " c "), (None, "x y"), ("9", "z")], "person_id string, text string")
    for skew in ({}, {"floor": 1, "max_heavy": 1000}):
        got = survey.analysis_frame(answers, said, **skew).select("person_id", "condition_avatar", "total_tokens").collect()
        assert sorted(map(tuple, got), key=str) == sorted([("1", 0, 3), ("1", 0, 3), (None, 0, None), ("5", 1, None)], key=str)


def test_single_answer_conditions_vanish(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None)], "condition string, EMP_Mean double")
    row = survey.condition_summary(frame, ["EMP_Mean"]).collect()
    assert [(r["condition"], r["mean"], r["count"], r["axis_max"]) for r in row] == [("a", 2.0, 2, 7)]
    assert row[0]["sem"] == pytest.approx(math.sqrt(2) / math.sqrt(2))


def test_text_is_not_read_without_need(spark):
    frame = survey.analysis_frame(proxies.survey(spark, FOLDER), None)
    assert "documents" not in frame._jdf.queryExecution().executedPlan().toString()
    assert "total_tokens" not in frame.columns


def test_study_without_text(spark):
    study = run_models(proxies.survey(spark, FOLDER), None, regression_models(1))
    table = study.predictions()[0]
    assert "total_tokens" not in table.columns
    assert table.count() == 1077


def test_tokens_read_two_columns(spark):
    plan = survey.token_totals(proxies.utterances(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "partial_sum" in plan


def test_moments_are_one_aggregation(frame):
    moments = collect_moments(frame, ALL)
    assert len(moments.cells) < 200
    assert moments.sample_size(ALL[0]) == 1077


def test_written_study(spark, tmp_path):
    study = run_models(proxies.survey(spark, FOLDER), proxies.utterances(spark, FOLDER), mediation_models())
    study.write(str(tmp_path))
    read = lambda part: spark.read.option("header", True).csv(f"{tmp_path}/{part}")
    assert read("coeffs").columns == ["term", "coefficients", "std", "t", "p-value", "Significance", "model", "outcome"]
    assert read("coeffs").count() == 57
    assert {r["outcome"] for r in read("fit_stats").collect()} == {"EMP_Mean", "EMP_1", "anthropomorphism"}
    assert read("predictions/path_a/anthropomorphism").count() == 597
    assert read("predictions/full_outcome/EMP_1").count() == 581
    assert read("by_condition/path_a").count() == 3


def test_mediation_effects_add_up_on_a_common_sample(spark, frame):
    fits = ols.fit_models(frame, mediation_models(common_sample=True))
    assert len({f.n for f in fits}) == 1
    for row in ols.mediation_effects(spark, fits, "condition_avatar", "anthropomorphism_score").collect():
        assert row["total"] == pytest.approx(row["direct"] + row["indirect"], abs=1e-9)
        assert row["indirect"] == pytest.approx(row["path_a"] * row["path_b"])


def test_rows_are_not_expanded_and_three_categories_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.normal() + 1e6 + k % 3), float(rng.normal() + 1e5), float(k % 7), "abc"[k % 3], "xy"[k % 2], "pqrs"[(k // 5) % 4]) for k in range(900)]
    frame = spark.createDataFrame(rows, "y double, x double, z double, g string, h string, `i j` string")
    seen = []
    collect = type(frame).collect
    try:
        type(frame).collect = lambda self: seen.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self)
        fits = {}
        for names in ((), ("g",), ("g", "h"), ("g", "h", "i j")):
            model = Model("m", "y", ("x", "z"), names, ("y", "x", "z", *names))
            fits[names] = ols.fit_models(frame, [model])[0]
    finally:
        type(frame).collect = collect
    assert len(seen) == 5 and not any("Expand" in plan for plan in seen[:4])
    assert "Expand" in seen[4] and "_n:bigint" in seen[4]  # over the finest groups, which are a table by then
    data = [dict(zip(frame.columns, r)) for r in rows]
    for names, fit in fits.items():
        columns = [np.ones(len(data))]
        for c in names:
            columns += [np.array([float(r[c] == level) for r in data]) for level in sorted({r[c] for r in data})[1:]]
        columns += [np.array([r[c] for r in data]) for c in ("x", "z")]
        x, y = np.array(columns).T, np.array([r["y"] for r in data])
        centred = x.copy()
        centred[:, -2:] -= x[:, -2:].mean(axis=0)
        beta = np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0]
        np.testing.assert_allclose(fit.beta[1:], beta[1:], rtol=1e-6, atol=1e-8)
