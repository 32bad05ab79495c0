"""Combining models and shaping results."""

from pyspark.sql import functions as F

from lunario.fixed import DECOMPOSED_GRID
from lunario.operators import export, panel, scoring
from lunario.operators.models import records
from lunario.operators.models.autoregression import decomposed_ar
from lunario.operators.models.trend_month import fit_trend_month, trend_month
from lunario.plans import sqlparts as sql
from lunario.plans.frames import SEGMENTS, panel_5
from lunario.plans.model_queries import HELD, HOLDOUT, none_held, shared_panel, split
from lunario.plans.regression_queries import decomposed_sql
from lunario.plans.registry import query, rounded

# Two closed-form models stand for two forecasting models of the same series.
PAIR = {
    "NP": {"growth": ["linear"], "seasonality_mode": ["additive"]},
    "LSTM": {"growth": ["linear"], "seasonality_mode": ["multiplicative"]},
}
PAIR_SQL = "(VALUES ('NP', 0), ('LSTM', 1)) AS m(model, id)"
HELD_5 = sql.tuned(sql.PANEL_5, sql.holdout(12, final=True))
STACKED = f"""stacked AS (
  SELECT model, series, ds, yhat FROM predicted JOIN {PAIR_SQL} ON param_id = id
  WHERE fold_id = -1 AND part = 'future')"""


def stacked(monthly):
    """Final forecasts of both models in one frame."""
    rows = split(monthly, none_held, final=True)
    frames = [
        fit_trend_month(rows, sets).where("part = 'future'").select("series", "ds", "yhat").withColumn("model", F.lit(m))
        for m, sets in PAIR.items()
    ]
    return scoring.stack_models(*frames)


def errors(monthly):
    """Holdout errors of both models per series."""
    rows = split(monthly, HOLDOUT)
    frames = [records.scores(trend_month(rows, sets)).withColumn("model", F.lit(m)) for m, sets in PAIR.items()]
    return scoring.stack_models(*frames)


@query(
    "stack_models",
    f"""{HELD}, {STACKED}
SELECT model, series, strftime(ds, '%Y-%m') AS ds, round(yhat, 4) AS yhat FROM stacked""",
)
def stack_models(spark, sf):
    return rounded(stacked(shared_panel(spark, sf)), "yhat")


@query(
    "ensemble_mean",
    f"""{HELD}, {STACKED}
SELECT series, strftime(ds, '%Y-%m') AS ds, round(avg(yhat), 4) AS yhat, count(*) AS n_models
FROM stacked GROUP BY series, stacked.ds HAVING count(DISTINCT model) >= 2""",
)
def ensemble_mean(spark, sf):
    return rounded(scoring.ensemble_mean(stacked(shared_panel(spark, sf))), "yhat")


@query(
    "history_union_forecast",
    f"""{HELD}, {STACKED}
SELECT series, strftime(ds, '%Y-%m') AS ds, 'history' AS kind, y AS value FROM panel
UNION ALL
SELECT series, strftime(ds, '%Y-%m'), 'forecast', round(yhat, 4) FROM stacked WHERE model = 'NP'""",
)
def history_union_forecast(spark, sf):
    monthly = shared_panel(spark, sf)
    ahead = rounded(stacked(monthly).where("model = 'NP'"), "yhat")
    history = monthly.select("series", "ds", F.col("y").alias("value"))
    return panel.union_history(history, ahead.select("series", "ds", F.col("yhat").alias("value")))


ALL_SCORES_SQL = f"""WITH RECURSIVE {decomposed_sql(DECOMPOSED_GRID["lags"], final=False)}, ar_scores AS (
  SELECT series, 'decomposed_ar' AS model, param_id, {sql.ERRORS}
  FROM predicted WHERE part = 'val' AND y IS NOT NULL GROUP BY ALL),
{sql.TREND_MONTH.replace("predicted AS", "month_predicted AS")}, month_scores AS (
  SELECT series, 'trend_month' AS model, param_id, {sql.ERRORS}
  FROM month_predicted WHERE part = 'val' AND y IS NOT NULL GROUP BY ALL)
SELECT series, model, CAST(param_id AS INTEGER) AS param_id, n, round(mape, 4) AS mape, round(mae, 4) AS mae,
       round(mse, 4) AS mse
FROM (SELECT * FROM ar_scores UNION ALL SELECT * FROM month_scores)"""


@query("all_model_scores", ALL_SCORES_SQL)
def all_model_scores(spark, sf):
    """Scores of every parameter set of two models in one frame."""
    rows = split(shared_panel(spark, sf, panel_5), HOLDOUT)
    frames = [
        records.scores(job).withColumn("model", F.lit(name))
        for name, job in [("decomposed_ar", decomposed_ar(rows)), ("trend_month", trend_month(rows))]
    ]
    scored = scoring.stack_models(*frames).withColumn("n", F.col("n").cast("bigint"))
    return rounded(scored.drop("fold_id"), "mape", "mae", "mse")


RECORDS_SQL = f"""{HELD}, {STACKED}, held AS (
  SELECT series, model, mape FROM scores JOIN {PAIR_SQL} ON param_id = id WHERE fold_id = 0), past AS (
  SELECT series, CAST(min(year(ds)) AS INTEGER) AS anio_inicio, CAST(count(*) AS INTEGER) AS n_history,
         strftime(min(ds), '%Y-%m') AS first_month, strftime(max(ds), '%Y-%m') AS last_month,
         CAST(round_even(sum(round_even(y, 0)), 0) AS BIGINT) AS history_total
  FROM panel GROUP BY series), ahead AS (
  SELECT series, model, CAST(count(*) AS INTEGER) AS n_forecast, strftime(max(ds), '%Y-%m') AS end_month,
         CAST(sum(CAST(round_even(yhat, 0) AS BIGINT)) AS BIGINT) AS forecast_total
  FROM stacked GROUP BY series, model)
SELECT a.series, a.model AS modelo, anio_inicio, n_history, first_month, last_month, history_total, n_forecast,
       end_month, forecast_total, CAST(round_even(mape, 2) AS DOUBLE) AS mape
FROM ahead a JOIN past USING (series) JOIN held h ON h.series = a.series AND h.model = a.model"""


@query("result_records", RECORDS_SQL)
def result_records(spark, sf):
    """Nested records, unfolded into lengths, ends and totals for comparison."""
    monthly = shared_panel(spark, sf)
    nested = export.result_records(stacked(monthly), monthly, errors(monthly))

    def total(points):
        return F.aggregate(points, F.lit(0).cast("bigint"), lambda s, p: s + p["valor"])

    return nested.select(
        "series", "modelo", "anio_inicio",
        F.size("historico").alias("n_history"),
        F.get("historico", F.lit(0))["fecha"].alias("first_month"),
        F.element_at("historico", -1)["fecha"].alias("last_month"),
        total(F.col("historico")).alias("history_total"),
        F.size("pronostico").alias("n_forecast"),
        F.element_at("pronostico", -1)["fecha"].alias("end_month"),
        total(F.col("pronostico")).alias("forecast_total"),
        "mape",
    )


def _columns(value, names=SEGMENTS, column="series"):
    return ", ".join(
        f"CAST(max(CASE WHEN {column} = '{n}' THEN round_even({value}, 0) END) AS BIGINT) AS {n}" for n in names
    )


@query(
    "export_history_wide",
    f"WITH {sql.PANEL_5}\nSELECT strftime(ds, '%Y-%m') AS fecha, {_columns('y')} FROM panel GROUP BY 1",
)
def export_history_wide(spark, sf):
    return export.export_history_wide(panel_5(spark, sf), SEGMENTS)


@query(
    "export_forecast_by_model",
    f"""{HELD_5}, {STACKED}
SELECT model, strftime(ds, '%Y-%m') AS fecha, {_columns('yhat')} FROM stacked GROUP BY 1, 2""",
)
def export_forecast_by_model(spark, sf):
    return export.export_forecast_by_model(stacked(shared_panel(spark, sf, panel_5)), SEGMENTS)


@query(
    "export_forecast_by_series",
    f"""{HELD}, {STACKED}
SELECT series, strftime(ds, '%Y-%m') AS fecha, {_columns('yhat', PAIR, 'model')} FROM stacked GROUP BY 1, 2""",
)
def export_forecast_by_series(spark, sf):
    return export.export_forecast_by_series(stacked(shared_panel(spark, sf)), list(PAIR))


@query(
    "export_error_table",
    f"""{HELD}, held AS (
  SELECT model, mape FROM scores JOIN {PAIR_SQL} ON param_id = id WHERE fold_id = 0), mean AS (
  SELECT model, avg(mape) AS mape FROM held GROUP BY model)
SELECT CASE model WHEN 'NP' THEN 'NeuralProphet' ELSE model END AS modelo,
       printf('%.1f%%', mape) AS mape_texto, 'MAPE esperado 1 año promedio nación' AS titulo
FROM mean""",
)
def export_error_table(spark, sf):
    """One row per model: the mean error over all series of the panel, which is by nation."""
    mean = scoring.macro_mean(errors(shared_panel(spark, sf)), ["model"])
    return export.export_error_table(
        mean.select("model", "mape", F.lit("atributo").alias("scope"), F.lit("nación").alias("attribute"))
    )
