"""The full run on the smallest tables, and its writers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lunario.fixed import TREND_SEASON_GRID_FULL
from lunario.operators import export, panel
from lunario.operators.models import records
from lunario.operators.models.trend_season import fit_trend_season, trend_season
from lunario.plans.forecasting import (
    cleaned_panel,
    fold_rows,
    forecast_all,
    forecast_with_rejects,
    planned_jobs,
    publish,
    publish_rejects,
)
from lunario.plans.frames import FILES, file_cells
from lunario.session import written
from lunario.sources.delimited import month_panel, read_series_files
from lunario.sources.sinks import write_forecasts, write_records
from test_models import SEASON, held_out
from test_panel import months

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def forecasts(spark):
    run = forecast_all(file_cells(spark, SF_DIR), rolling=(36, 12, 12), models=["NP", "LSTM"])
    return written(run, "forecasts")


def test_every_file_and_series_is_forecast_without_holes(spark, forecasts):
    spans = forecasts.groupBy("file_id", "series", "model").agg(
        F.count("*").alias("n"), F.min("ds").alias("first"), F.max("ds").alias("last"), F.count("yhat").alias("known")
    ).collect()
    assert {r.file_id for r in spans} == set(FILES)
    for r in spans:
        assert r.last == dt.date(2004, 12, 1)
        assert r.n == r.known == (2004 - r.first.year) * 12 + 12 - r.first.month + 1
    per_file = {}
    for r in spans:
        per_file.setdefault(r.file_id, set()).add((r.series, r.model))
    # five series where the file is by attribute, one where it is national;
    # the second group of metrics has no LSTM
    assert {f: len(v) for f, v in per_file.items()} == dict(zip(FILES, [5, 10, 2, 1]))


def test_published_rows(spark, forecasts):
    rows = publish(forecasts)
    assert rows.columns == [
        "metric", "scope", "attribute", "file_id", "series", "model", "ds", "yhat", "valor", "lower", "upper",
        "mape", "status",
    ]
    by_model = rows.groupBy("file_id", "series", "ds").pivot("model", ["NP", "LSTM", "Ensemble"]).agg(F.first("yhat"))
    both = by_model.where("LSTM is not null")
    assert both.count() > 0
    outside = both.where("Ensemble < least(NP, LSTM) - 1e-9 or Ensemble > greatest(NP, LSTM) + 1e-9")
    assert outside.count() == 0
    assert by_model.where("LSTM is null and Ensemble is not null").count() == 0
    assert rows.where("valor <> bround(yhat, 0)").count() == 0
    assert {r.metric for r in rows.select("metric").distinct().collect()} == {
        "Contratos", "Parados", "Afiliados", "P. contratadas",
    }


def test_writers(spark, forecasts, tmp_path):
    keys = ("file_id", "series")
    history = month_panel(file_cells(spark, SF_DIR))
    errors = forecasts.groupBy(*keys, "model").agg(F.first("mape").alias("mape"))
    nested = export.result_records(forecasts, history, errors, keys)
    write_records(nested, str(tmp_path / "records"))
    back = spark.read.json(str(tmp_path / "records"))
    assert back.count() == errors.count()
    point = back.select(F.explode("historico").alias("p")).select("p.*").where("valor is not null").first()
    assert len(point.fecha) == 7 and isinstance(point.valor, int)
    write_forecasts(forecasts, str(tmp_path / "forecasts"))
    assert spark.read.parquet(str(tmp_path / "forecasts")).where("model = 'NP'").count() == forecasts.where(
        "model = 'NP'"
    ).count()


def test_jobs_cover_the_registry():
    jobs = planned_jobs()
    assert sorted((g, s, m) for m, g, _, scopes in jobs for s in scopes) == sorted(
        [("abc", s, m) for s in ("estatal", "atributo") for m in ("NP", "LSTM")]
        + [("de", s, m) for s in ("estatal", "atributo") for m in ("NP", "XGBoost")]
    )
    assert len(planned_jobs()) == 5


def test_the_full_trend_grid_runs(spark):
    """Twelve sets with up to fifty changepoints, more columns than training months."""
    series = months(spark, 120, value=f"100D + 0.7D * i + {SEASON}")
    fits = trend_season(held_out(series), TREND_SEASON_GRID_FULL)
    chosen = records.choose(fits).first()
    assert chosen.mape < 0.1 and chosen.n_folds == 1
    assert all(p.yhat is not None for p in chosen.forecast)


def observed(spark, tmp_path, **files):
    for metric, content in files.items():
        (tmp_path / f"{metric} desde 2000 por CCAA.csv").write_text(content)
    return read_series_files(spark, str(tmp_path))


MONTHLY = [f"{2000 + k // 12}-{k % 12 + 1:02d}" for k in range(40)]


def test_one_file_of_one_group_with_trees_alone(spark, tmp_path):
    obs = observed(spark, tmp_path, Contratos="Fecha;A\n" + "".join(f"{m};{100000 + 5000 * (k % 12)}\n" for k, m in enumerate(MONTHLY)))
    grid = {"XGBoost": {"colsample_bytree": [1.0], "learning_rate": [0.5], "max_depth": [3], "n_estimators": [20]}}
    rows = publish(forecast_all(obs, models=["XGBoost"], grids=grid)).collect()
    assert len(rows) == 8 + 12 * 3 and {r.model for r in rows} == {"XGBoost"}
    assert all(r.status == "tuned" and r.lower <= r.yhat <= r.upper and r.mape < 5 for r in rows)
    widths = [r.upper - r.lower for r in sorted(rows, key=lambda r: r.ds)]
    assert widths == pytest.approx(sorted(widths))


def test_a_file_without_values(spark, tmp_path):
    obs = observed(spark, tmp_path, Contratos="Fecha;A\n" + "".join(f"{m};'-\n" for m in MONTHLY))
    rows = publish(forecast_all(obs)).collect()
    assert {r.model for r in rows} == {"NP", "XGBoost", "Ensemble"}
    assert {(r.yhat, r.lower, r.upper, r.mape) for r in rows} == {(None, None, None, None)}
    assert {r.status for r in rows if r.model != "Ensemble"} == {"no_folds"}


def test_a_mistyped_year_is_a_reject_of_the_run(spark, tmp_path):
    lines = [f"{m};{k + 1}" for k, m in enumerate(MONTHLY)] + ["1003-05;7"]
    obs = observed(spark, tmp_path, Parados="Fecha;A\n" + "\n".join(lines) + "\n")
    forecasts, rejects = forecast_with_rejects(obs, models=["NP"])
    assert [(r.fecha_raw, r.raw, r.reason) for r in publish_rejects(rejects).collect()] == [("1003-05", "7.0", "far_month")]
    assert forecasts.count() == 8 + 12 * 3


def test_jobs_read_the_fold_rows_without_another_exchange(spark):
    usable, _ = cleaned_panel(file_cells(spark, SF_DIR))
    rows = fold_rows(usable, lambda t, n: panel.holdout_folds(12)(t, n), F.add_months("last_ds", 12))
    fits = fit_trend_season(rows.drop("metric_group", "scope"), keys=("file_id", "series"))
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
