"""The full run over the written input files."""

from pyspark.sql import functions as F

from lunario.fixed import DECOMPOSED_GRID, TREND_SEASON_GRID, TREND_SEASON_PANEL_GRID
from lunario.operators.intervals import AROUND, COVERAGE
from lunario.plans import sqlparts as sql
from lunario.functions.calendar import default_horizon
from lunario.operators import export, panel
from lunario.plans.control import control_rows
from lunario.plans.file_queries import ACCENT, WIDE_ROWS, named, write_files
from lunario.plans.forecasting import cleaned_panel, fold_rows, forecast_with_rejects, publish, publish_rejects
from lunario.plans.frames import file_cells
from lunario.plans.regression_queries import ar_chain, decomposed_sql, linear_ar_design, trend_chain
from lunario.plans.registry import query, rounded
from lunario.session import values_frame, written
from lunario.sources.delimited import month_panel, read_series_files
from lunario.sources.names import base_name


# Amounts are in millions; the shortest windows fit 23 columns to 36 months, so two solvers agree to about 1e-9 of them.
PLACES = -2


CONTROL_ROWS = [
    ("Contratos desde 1995 por sector.csv", None, "2002-06-01", None, None),
    ("Parados desde 1995 por sector.csv", None, None, 2, 3),
    ("Afiliados desde 1995 estatal.csv", "1999-05-01", None, None, None),
]
RANGED = "Contratos desde 1995 por sector 2001-2003.csv"


def _controls(spark):
    rows = values_frame(spark, ["file", "as_of", "forecast_end", "first_column", "last_column"], CONTROL_ROWS)
    return control_rows(rows)


@query(
    "run_controls",
    f"""WITH {WIDE_ROWS}, files AS (
  SELECT * FROM obs
  UNION ALL
  SELECT grp, '{RANGED}', ds, segment, i, y FROM obs WHERE grp = 0)
SELECT file_id, segment AS series,
       CASE WHEN file_id = '{RANGED}' THEN '2003-12'
            WHEN grp = 0 THEN '2002-06' WHEN grp = 2 THEN '2002-12' ELSE '2004-12' END AS until,
       count(*) AS n_history
FROM files WHERE (grp < 2 OR i = 0) AND (grp <> 1 OR i IN (1, 2)) GROUP BY ALL""",
)
def run_controls(spark, sf):
    """An end, a range of columns and a date of the run by file, an end by the file's name, and the default."""
    obs = written(file_cells(spark, sf), "cells")
    renamed = obs.where(F.col("file_id") == CONTROL_ROWS[0][0]).withColumn("file_id", F.lit(RANGED))
    usable, _ = cleaned_panel(obs.unionByName(renamed), _controls(spark))
    rows = fold_rows(usable, lambda t, n: panel.holdout_folds(12)(t, n), default_horizon(F.col("last_ds")))
    whole = rows.where(F.col("fold_id") == panel.FINAL)
    history = F.count(F.when(F.col("part") == "train", 1))
    return whole.groupBy("file_id", "series").agg(F.max("ds").alias("until"), history.alias("n_history"))


def _run(spark, sf, **options):
    obs = read_series_files(spark, write_files(spark, sf, mark=""))
    return forecast_with_rejects(obs, rolling=sql.ROLLING_36, **options)


# -- check SQL: each part is one model over one of the files --------------------

NAME = f"CASE WHEN grp >= 2 THEN '{ACCENT}' ELSE '' END || segment"
END = "make_date(CAST(year(last_ds) + 3 AS INTEGER), 12, 1)"


def _fold_rows(group):
    """CTEs up to the fold rows of one file; national files keep their first column and roll."""
    national = group >= 2
    split = sql.rolling(*sql.ROLLING_36, final=True) if national else sql.holdout(12, final=True)
    return f"""{WIDE_ROWS}, panel AS (
  SELECT file_id || '|' || {NAME} AS series, ds, y FROM obs
  WHERE grp = {group}{" AND i = 0" if national else ""}), {sql.spine(END)}, {split}"""


def _part(model, chain):
    return f"""SELECT * FROM (WITH RECURSIVE {chain}, {sql.SCORES}, {sql.MEANS}, {sql.bounds(
        "predicted WHERE (series, param_id) IN (SELECT (series, param_id) FROM best)", COVERAGE, AROUND)}
SELECT p.series, '{model}' AS model, p.ds, p.yhat, p.yhat - w.width AS lower, p.yhat + w.width AS upper, b.mape
FROM predicted p JOIN best b ON b.series = p.series AND b.param_id = p.param_id
LEFT JOIN widths w ON w.series = p.series AND w.step = p.t - p.n + 1
WHERE p.fold_id = -1 AND p.part = 'future')"""


def _every_sql():
    """``every``: forecast months of all models but trees."""
    (bends,), (panel_bends,) = TREND_SEASON_GRID["n_changepoints"], TREND_SEASON_PANEL_GRID["n_changepoints"]
    parts = [_part("NP", f"{sql.filled(_fold_rows(g))}, {trend_chain(multiplicative=False)}") for g in (0, 3)]
    for group, points in ((1, panel_bends), (2, bends)):
        parts.append(_part("NP", f"{sql.filled(_fold_rows(group))}, {ar_chain(*linear_ar_design(points), 1)}"))
        parts.append(_part("LSTM", decomposed_sql(DECOMPOSED_GRID["lags"], final=True, source=_fold_rows(group))))
    return f"every AS ({' UNION ALL '.join(parts)})"


def _regressions_sql():
    return f"""WITH {_every_sql()}, published AS (
  SELECT * FROM every
  UNION ALL
  SELECT series, 'Ensemble', ds, avg(yhat), avg(lower), avg(upper), NULL FROM every
  GROUP BY series, ds HAVING count(DISTINCT model) >= 2)
SELECT split_part(series, '|', 1) AS file_id, split_part(series, '|', 2) AS series, model,
       strftime(ds, '%Y-%m') AS ds, round(yhat, {PLACES}) AS yhat, round(lower, {PLACES}) AS lower,
       round(upper, {PLACES}) AS upper, round(mape, 4) AS mape
FROM published"""


@query("end_to_end_regressions", _regressions_sql())
def end_to_end_regressions(spark, sf):
    """Scan of all written input files to the published forecasts of all models but trees."""
    forecasts, _ = _run(spark, sf, models=["NP", "LSTM"])
    rows = publish(written(forecasts, "forecasts"))
    rows = rows.select(named(), "series", "model", "ds", "yhat", "lower", "upper", "mape")
    return rounded(rounded(rows, "yhat", "lower", "upper", places=PLACES), "mape")


FILE_ERRORS = f"""{_every_sql()}, fitted AS (
  SELECT split_part(series, '|', 1) AS file_id, model, series, min(mape) AS mape, count(*) AS n_forecast
  FROM every GROUP BY ALL), files AS (
  SELECT file_id, model AS modelo, count(*) AS n_series, CAST(sum(n_forecast) AS BIGINT) AS n_forecast,
         CAST(round_even(avg(mape), 2) AS DOUBLE) AS mape
  FROM fitted GROUP BY ALL)"""
OF_FILE = """split_part(file_id, ' desde', 1) AS metrica,
       CASE WHEN file_id LIKE '%estatal%' THEN 'estatal' ELSE 'atributo' END AS modo,
       CASE WHEN file_id LIKE '%sector%' THEN 'sector' END AS atributo"""


def _file_records(spark, sf):
    obs = written(read_series_files(spark, write_files(spark, sf, mark="")), "observations")
    forecasts, _ = forecast_with_rejects(obs, rolling=sql.ROLLING_36, models=["NP", "LSTM"])
    published = publish(written(forecasts, "forecasts")).where("model <> 'Ensemble'")
    return export.file_records(published, month_panel(obs))


@query(
    "file_records",
    f"""WITH {FILE_ERRORS}, {WIDE_ROWS}, months AS (SELECT file_id, count(DISTINCT ds) AS n_months FROM obs GROUP BY 1)
SELECT file_id, {OF_FILE}, modelo, CAST(1995 AS INTEGER) AS anio_inicio, n_series, n_forecast, n_series * n_months AS n_history, mape
FROM files JOIN months USING (file_id)""",
)
def file_records(spark, sf):
    """One nested record per file and model, unfolded into sizes for comparison."""

    def total(column):
        return F.aggregate(F.map_values(column), F.lit(0).cast("bigint"), lambda n, p: n + F.size(p))

    return _file_records(spark, sf).select(
        named(), "metrica", "modo", "atributo", "modelo", "anio_inicio",
        F.size("pronostico").cast("bigint").alias("n_series"),
        total("pronostico").alias("n_forecast"), total("historico").alias("n_history"), "mape",
    )


@query(
    "file_error_table",
    f"""WITH {FILE_ERRORS}
SELECT file_id, CASE modelo WHEN 'NP' THEN 'NeuralProphet' ELSE modelo END AS modelo, printf('%.1f%%', CAST(round(CAST(mape AS DECIMAL(18, 2)), 1) AS DOUBLE)) AS mape_texto,
       CASE WHEN file_id LIKE '%sector%' THEN 'MAPE esperado 1 año promedio sector' ELSE 'MAPE esperado 3 años' END AS titulo
FROM files""",
)
def file_error_table(spark, sf):
    """The error table of every file, titled by what its name says; halves of the record's two-place error go up."""
    errors = export.file_errors(_file_records(spark, sf)).withColumn("file_id", base_name(F.col("file_id")))
    return export.export_error_table(errors)


@query(
    "end_to_end_rejects",
    f"""WITH {WIDE_ROWS}
SELECT file_id, {NAME} AS series, CAST(i + 1 AS INTEGER) AS col_pos, 'not_first_column' AS reason, count(*) AS n
FROM obs WHERE grp >= 2 AND i > 0 GROUP BY ALL""",
)
def end_to_end_rejects(spark, sf):
    """What the same run leaves out: here the further columns of national files."""
    _, rejects = _run(spark, sf, models=["NP"])
    return (
        publish_rejects(rejects)
        .groupBy(named(), "series", "col_pos", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("end_to_end_forecast")
def end_to_end_forecast(spark, sf):
    """Scan of all written input files to forecasts of every available model and their mean."""
    forecasts, _ = _run(spark, sf)
    return publish(written(forecasts, "forecasts")).withColumn("file_id", base_name(F.col("file_id")))
