"""Models recover what they should from exact inputs."""

import math

import pytest
from pyspark.sql import functions as F

from lunario.operators import panel
from lunario.operators.models import records
from lunario.operators.models.autoregression import ar2_fit, decomposed_ar, recursive_forecast
from lunario.operators.models.trees import panel_trees
from lunario.operators.models.trend_season import fit_trend_season, trend_season
from test_panel import months

SEASON = "10D * cos(0.5235987755982988D * month(add_months(date'2000-01-01', i))) + 4D * sin(1.0471975511965976D * month(add_months(date'2000-01-01', i)))"


def held_out(rows, horizon=12):
    return panel.assign_folds(
        panel.extend_months(rows, F.add_months("last_ds", horizon)), panel.holdout_folds(12), final=True
    )


def grid(growth="linear", points=10, mode="additive"):
    return {"growth": [growth], "n_changepoints": [points], "seasonality_mode": [mode]}


def worst(frame, truth):
    return frame.agg(F.max(F.abs(F.col("yhat") - truth))).first()[0]


def test_additive_trend_and_season_are_recovered(spark):
    series = months(spark, 96, value=f"100D + 0.7D * i + {SEASON}")
    chosen = records.choose(trend_season(held_out(series), grid()))
    assert chosen.first().mape < 1e-4
    ahead = records.forecast_rows(chosen)
    i = "months_between(ds, date'2000-01-01')"
    truth = F.expr(f"100D + 0.7D * {i} + " + SEASON.replace("add_months(date'2000-01-01', i)", "ds"))
    assert ahead.count() == 12
    assert worst(ahead, truth) < 1e-4


def test_changepoints_are_recovered(spark):
    """One kink at the first of two changepoints, one jump at the second."""
    n = 91
    knots = [0.8 / 3 * (n - 1), 1.6 / 3 * (n - 1)]
    value = f"50D + 0.2D * i + 1.5D * greatest(i - {knots[0]}D, 0D) + if(i >= {knots[1]}D, 30D, 0D)"
    rows = panel.assign_folds(
        panel.extend_months(months(spark, n, value=value), F.add_months("last_ds", 6)),
        lambda t, m: F.array().cast("array<struct<fold_id:int,start_idx:int,train_n:int,val_n:int>>"),
        final=True,
    )
    ahead = records.forecast_rows(records.choose(trend_season(rows, grid("discontinuous", 2))))
    i = "months_between(ds, date'2000-01-01')"
    assert worst(ahead, F.expr(f"50D + 0.2D * {i} + 1.5D * ({i} - {knots[0]}D) + 30D")) < 1e-2


def test_multiplicative_season_is_recovered(spark):
    season = "(1D + 0.2D * cos(0.5235987755982988D * month(add_months(date'2000-01-01', i))))"
    series = months(spark, 108, value=f"(200D + 3D * i) * {season}")
    modes = {"growth": ["linear"], "n_changepoints": [1], "seasonality_mode": ["additive", "multiplicative"]}
    chosen = records.choose(trend_season(held_out(series), modes))
    row = chosen.first()
    assert row.param_id == 1 and row.mape < 2.5


def test_autoregression_is_recovered_and_recursive(spark):
    """y = 2 + 0.6 y(-1) + 0.3 y(-2) plus season: the recursion follows the true path."""
    values = [5.0, 9.0]
    for m in range(2, 130):
        values.append(2 + 0.6 * values[-1] + 0.3 * values[-2] + 3 * math.cos(math.pi * (m % 12 + 1) / 6))
    full = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, y double").select(
        F.lit("a").alias("series"), F.expr("add_months(date'2000-01-01', i)").alias("ds"), "y"
    )
    known = full.where("ds < date'2010-01-01'")
    chosen = records.choose(trend_season(held_out(known, 10), grid(points=1), lags=2))
    ahead = records.forecast_rows(chosen).join(full, ["series", "ds"])
    assert ahead.count() == 10
    assert worst(ahead, F.col("y")) < 1e-3


def test_ar2_closed_form(spark):
    values = [10.0, 4.0]
    for _ in range(60):
        values.append(1 + 0.5 * values[-1] - 0.4 * values[-2])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "t int, y double").select(
        F.lit("a").alias("series"), "t", "y"
    )
    coefs = ar2_fit(panel.ar_lags(rows.where("t < 40"), 2))
    row = coefs.first()
    assert [round(v, 6) for v in (row.const, row.phi_1, row.phi_2)] == [1.0, 0.5, -0.4]
    seeded = coefs.withColumn("seed", F.array(F.lit(values[39]), F.lit(values[38])))
    got = recursive_forecast(seeded, 5).first()["values"]
    assert got == pytest.approx(values[40:45], abs=1e-6)


def test_gaps_and_nulls_do_not_break_fits(spark):
    series = months(spark, 96, value=f"100D + 0.7D * i + {SEASON}").where("month(ds) <> 5 or year(ds) < 2005")
    masked = series.withColumn("y", F.when((F.month("ds") + F.year("ds")) % 9 != 0, F.col("y")))
    for lags in (0, 2):
        chosen = records.choose(trend_season(held_out(masked), grid(points=1), lags=lags))
        row = chosen.first()
        assert row.mape is not None and row.mape < 5
        assert records.forecast_rows(chosen).where("yhat is null").count() == 0
    assert records.choose(decomposed_ar(held_out(masked), {"lags": [2, 6]})).first().mape < 5


def test_decomposed_ar_on_short_series(spark):
    """Lags a set does not use may reach before the first month."""
    chosen = records.choose(decomposed_ar(held_out(months(spark, 26, value=f"40D + {SEASON}")), {"lags": [2, 18]}))
    assert chosen.first().param_id == 0
    assert records.forecast_rows(chosen).where("yhat is null").count() == 0


def test_one_record_per_fit(spark):
    two = months(spark, 60).union(months(spark, 72, series="b"))
    fits = fit_trend_season(held_out(two), grid(points=1))
    assert sorted((r.series, r.fold_id) for r in fits.collect()) == [("a", -1), ("a", 0), ("b", -1), ("b", 0)]


def test_trees_beat_the_series_mean(spark):
    names = [(f"s{k}", 50.0 + 30 * k) for k in range(4)]
    parts = [months(spark, 84, series=n, value=f"{v}D * (1D + 0.4D * cos(0.5235987755982988D * (i % 12)))") for n, v in names]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    settings = {"colsample_bytree": [1.0], "learning_rate": [0.3], "max_depth": [3], "n_estimators": [3, 8]}
    none = {"reg_lambda": 0.0, "reg_alpha": 0.0, "gamma": 0.0}
    chosen = records.choose(panel_trees(held_out(rows), settings, penalties=none))
    found = {r.series: r for r in chosen.collect()}
    assert set(found) == {n for n, _ in names}
    # the plain mean is off by about a quarter on such a season
    assert all(r.mape < 8 for r in found.values())
    assert records.forecast_rows(chosen).count() == 4 * 12
