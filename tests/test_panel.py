"""Spine, splits, lags and choices on small panels."""

import pytest
from pyspark.sql import functions as F

from lunario.operators import grid, panel, scoring
from lunario.operators.decompose import deseasonalize, detrend_quadratic, revert_transforms
from lunario.operators.models import records
from lunario.operators.models.trend_month import trend_month


def months(spark, n, series="a", start="2000-01-01", value="cast(i as double)"):
    return spark.sql(
        f"""SELECT '{series}' AS series, add_months(date'{start}', i) AS ds, {value} AS y
            FROM (SELECT explode(sequence(0, {n - 1})) AS i)"""
    )


def test_spine_fills_gaps_and_future(spark):
    holes = months(spark, 10).where("month(ds) not in (3, 4, 9)")
    rows = panel.extend_months(holes, F.add_months("last_ds", 2)).orderBy("ds").collect()
    assert [r.ds.month for r in rows] == list(range(1, 13))
    assert [r.t for r in rows] == list(range(12))
    assert [r.ds.month for r in rows if r.is_gap] == [3, 4, 9]
    assert [r.ds.month for r in rows if r.is_future] == [11, 12]
    assert {r.n for r in rows} == {10}


def test_end_before_last_month_adds_nothing(spark):
    rows = panel.extend_months(months(spark, 5), F.lit("1999-01-01").cast("date"))
    assert rows.count() == 5


@pytest.mark.parametrize("n, train, val, step", [(79, 36, 12, 12), (180, 96, 36, 12), (50, 20, 7, 3), (30, 10, 5, 20)])
def test_rolling_folds_match_the_definition(spark, n, train, val, step):
    rows = panel.assign_folds(panel.with_span(months(spark, n)), panel.rolling_folds(train, val, step))
    got = sorted((r.fold_id, r.t, r.part) for r in rows.collect())
    want, start, fold = [], 0, 0
    while start + train + val <= n:
        want += [(fold, t, "train" if t < start + train else "val") for t in range(start, start + train + val)]
        start, fold = start + step, fold + 1
    assert got == sorted(want)


def test_short_history_has_no_folds_but_a_forecast(spark):
    rows = panel.assign_folds(
        panel.extend_months(months(spark, 79, value="100D + i"), F.add_months("last_ds", 6)),
        panel.rolling_folds(96, 36, 12),
        final=True,
    )
    chosen = records.choose(trend_month(rows))
    row = chosen.first()
    assert (row.status, row.n_folds, row.mape, row.param_id) == ("no_folds", 0, None, 0)
    ahead = records.forecast_rows(chosen).orderBy("ds").collect()
    assert [round(r.yhat, 6) for r in ahead] == [179.0, 180.0, 181.0, 182.0, 183.0, 184.0]


def test_holdout_context_and_lags_do_not_look_ahead(spark):
    rows = panel.ar_lags(panel.monthly_spine(months(spark, 30)), 3)
    for r in rows.collect():
        for k in (1, 2, 3):
            value = r[f"lag_{k}"]
            assert value is None if r.t < k else value == r.t - k
    marked = panel.holdout_split(panel.with_span(months(spark, 30)), 12, context=2)
    got = {(r.part, r.is_context): r.n for r in marked.groupBy("part", "is_context").agg(F.count("*").alias("n")).collect()}
    assert got == {("train", False): 16, ("train", True): 2, ("val", False): 12}


def test_carry_forward_uses_the_past_only(spark):
    gaps = panel.monthly_spine(months(spark, 12).where("month(ds) not in (3, 4)"))
    rows = {r.t: r.y_known for r in panel.carry_forward(gaps).collect()}
    assert rows[2] == rows[3] == 1.0 and rows[4] == 4.0


def test_grid_order(spark):
    table = grid.param_grid(spark, {"b": [1, 2], "a": ["x", "y"]}).orderBy("param_id").collect()
    assert [(r.a, r.b) for r in table] == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]


def test_best_set_ties_nan_and_missing(spark):
    nan = float("nan")
    means = spark.createDataFrame(
        [("a", 0, nan), ("a", 1, 5.0), ("a", 2, 5.0), ("b", 0, None), ("b", 1, nan), ("c", 0, 3.0 + 1e-12), ("c", 1, 3.0)],
        "series string, param_id int, mape double",
    ).withColumn("mae", F.lit(1.0))
    best = {r.series: r.param_id for r in scoring.best_params(means).collect()}
    assert best == {"a": 1, "b": 0, "c": 0}
    first = {r.series: r.param_id for r in scoring.rank_params(means).where("rank = 1").collect()}
    assert first == best


def test_macro_mean_skips_missing(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "series string, mape double")
    got = scoring.macro_mean(rows.withColumn("mae", F.lit(2.0))).first()
    assert (got.mape, got.n_series) == (2.0, 2)


def test_ensemble_lies_between_models(spark):
    rows = spark.createDataFrame(
        [("a", "NP", 1.0), ("a", "LSTM", 3.0), ("b", "NP", 7.0)], "series string, model string, yhat double"
    ).withColumn("ds", F.lit("2020-01-01").cast("date"))
    got = scoring.ensemble_mean(rows).collect()
    assert [(r.series, r.yhat, r.n_models) for r in got] == [("a", 2.0, 2)]


def test_large_grids_run_like_small_ones(spark):
    values = {"a": list(range(100)), "b": ["x", "y"], "c": [k / 4 for k in range(60)]}
    rows = grid.param_grid(spark, values).orderBy("param_id").collect()
    assert [tuple(r)[1:] for r in rows] == grid.grid_rows(values)[1]
    assert grid.with_params(spark.range(2), values).count() == 24_000


def test_decomposition_reverts_and_recovers(spark):
    value = "3D + 0.5D * i + 0.02D * i * i + 4D * cos(3.141592653589793D * i / 6)"
    rows = deseasonalize(detrend_quadratic(panel.monthly_spine(months(spark, 120, value=value))))
    worst = revert_transforms(rows).agg(F.max(F.abs(F.col("yhat") - F.col("y")))).first()[0]
    assert worst < 1e-9
    assert rows.agg(F.max(F.abs("z"))).first()[0] < 0.2
    centre = rows.groupBy(F.month("ds").alias("m")).agg(F.first("season").alias("s")).agg(F.sum("s")).first()[0]
    assert abs(centre) < 1e-9


def test_far_months(spark):
    """Short islands go, the largest and long ones stay; a spine has the real months only."""
    def dates(series, *spans):
        return [(series, year + m // 12, m % 12 + 1) for year, n in spans for m in range(n)]

    rows = dates("typo", (2012, 3), (1012, 1)) + dates("break", (1980, 13), (2000, 30)) + dates("tie", (1980, 2), (2000, 2))
    panel_rows = spark.createDataFrame(rows, "series string, y int, m int").select(
        "series", F.expr("make_date(y, m, 1)").alias("ds"), F.lit(1.0).alias("y")
    )
    found = panel.far_months(panel_rows)
    far = {(r.series, r.ds.year) for r in found.where("reason = 'far_month'").collect()}
    assert far == {("typo", 1012), ("tie", 1980)}
    assert panel.monthly_spine(found.where("reason is null").drop("reason")).where("series = 'typo'").count() == 3
    assert panel.far_months(panel_rows.where("false")).count() == 0


def test_missing_training_values(spark):
    values = [None, 10.0, None, None, 40.0, *[None] * 11, 100.0, 5.0, None]
    parts = ["train"] * 17 + ["val"] * 2
    rows = spark.createDataFrame(
        [("a", 0, t, p, v) for t, (p, v) in enumerate(zip(parts, values))], "series string, fold_id int, t int, part string, y double"
    )
    got = [(r.y, r.fill) for r in panel.fill_missing(rows).orderBy("t").collect()]
    # the first month has no value before it; validation rows are neither filled nor looked at
    assert got[:5] == [(25.0, "mean"), (10.0, "observed"), (20.0, "linear"), (30.0, "linear"), (40.0, "observed")]
    assert got[5] == (25.0, "mean") and got[10] == (50.0, "mean") and got[15] == (100.0, "mean")
    assert got[16:] == [(100.0, "observed"), (5.0, "observed"), (None, None)]
    none = rows.withColumn("y", F.lit(None).cast("double"))
    assert {(r.y, r.fill) for r in panel.fill_missing(none).collect()} == {(None, None)}
