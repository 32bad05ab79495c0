"""Scores, choices and forecasts of the closed-form models."""

from pyspark.sql import functions as F

from lunario.operators import panel, scoring
from lunario.operators.grid import param_grid
from lunario.operators.intervals import AROUND, COVERAGE, with_bounds
from lunario.fixed import TREND_MONTH_GRID
from lunario.operators.models import autoregression, records
from lunario.operators.models.trend_month import fit_trend_month, trend_month
from lunario.plans import sqlparts as sql
from lunario.plans.frames import panel_5, panel_25
from lunario.plans.registry import query, rounded
from lunario.session import written

HOLDOUT = panel.holdout_folds(12)
ROLLING = panel.rolling_folds(*sql.ROLLING_36)
LINEAR = {"growth": ["linear"], "seasonality_mode": ["additive"]}


def split(monthly, scheme, final=False):
    """Fold rows of a panel with twelve future months."""
    return panel.assign_folds(panel.extend_months(monthly, F.add_months("last_ds", 12)), scheme, final)


def fold_rows(spark, sf, scheme, final=False):
    return split(panel_25(spark, sf), scheme, final)


def shared_panel(spark, sf, source=panel_25):
    """The panel written once, for queries that use it more than once."""
    return written(source(spark, sf), "panel")


HELD = sql.tuned(sql.PANEL_25, sql.holdout(12, final=True))
ROLLED = sql.tuned(sql.PANEL_25, sql.rolling(*sql.ROLLING_36, final=True))
FIRST = "param_id = 0 AND fold_id = 0 AND part = 'val' AND y IS NOT NULL"


def _validated(spark, sf):
    """Validation rows of the linear additive model, actual and predicted."""
    return fit_trend_month(fold_rows(spark, sf, HOLDOUT), LINEAR)


@query(
    "score_join",
    f"""{HELD}
SELECT series, strftime(ds, '%Y-%m') AS ds, CAST(param_id AS INTEGER) AS param_id, CAST(fold_id AS INTEGER) AS fold_id,
       y, round(yhat, 4) AS yhat
FROM predicted WHERE fold_id = 0 AND part = 'val' AND y IS NOT NULL""",
)
def score_join(spark, sf):
    """Join of the actual validation values with predictions made without them."""
    rows = split(shared_panel(spark, sf), HOLDOUT)
    hidden = rows.withColumn("y", F.when(F.col("part") == "train", F.col("y")))
    predictions = fit_trend_month(hidden).where("part = 'val'").select(
        "series", "ds", "param_id", "fold_id", "yhat"
    )
    actual = rows.where("part = 'val' and y is not null").select("series", "ds", "fold_id", "y")
    return rounded(scoring.score_join(actual, predictions), "yhat")


def _error(name, expression):
    return f"{HELD}\nSELECT series, round({expression}, 4) AS {name} FROM predicted WHERE {FIRST} GROUP BY series"


def _scored(spark, sf, name):
    held = scoring.score(_validated(spark, sf).where("part = 'val'"), ["series"])
    return rounded(held.select("series", name), name)


@query("mape", _error("mape", "avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) * 100"))
def mape(spark, sf):
    return _scored(spark, sf, "mape")


@query("mae", _error("mae", "avg(abs(y - yhat))"))
def mae(spark, sf):
    return _scored(spark, sf, "mae")


@query("mse", _error("mse", "avg((y - yhat) * (y - yhat))"))
def mse(spark, sf):
    return _scored(spark, sf, "mse")


@query(
    "train_mape",
    f"""{HELD}
SELECT series, count(*) AS n,
       round(avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) * 100, 4) AS mape
FROM predicted WHERE param_id = 0 AND fold_id = 0 AND part = 'train' AND y IS NOT NULL GROUP BY series""",
)
def train_mape(spark, sf):
    """In-sample error over all months: the model has no lags to wait for."""
    fitted = _validated(spark, sf).where("part = 'train'")
    return rounded(scoring.score(fitted, ["series"]).select("series", "n", "mape"), "mape")


def _rolled(spark, sf):
    return trend_month(fold_rows(spark, sf, ROLLING, final=True))


def _held(spark, sf):
    return trend_month(fold_rows(spark, sf, HOLDOUT, final=True))


MEAN_COLUMNS = "series, CAST(param_id AS INTEGER) AS param_id, round(mape, 4) AS mape, round(mae, 4) AS mae, n_folds"


@query("fold_mean", f"{ROLLED}\nSELECT {MEAN_COLUMNS} FROM means")
def fold_mean(spark, sf):
    means = scoring.fold_mean(records.scores(_rolled(spark, sf)))
    return rounded(means, "mape", "mae")


@query("best_params", f"{ROLLED}\nSELECT {MEAN_COLUMNS} FROM best")
def best_params(spark, sf):
    return rounded(scoring.best_params(scoring.fold_mean(records.scores(_rolled(spark, sf)))), "mape", "mae")


@query("rank_params", f"{ROLLED}\nSELECT {MEAN_COLUMNS}, CAST(rank AS INTEGER) AS rank FROM ranked")
def rank_params(spark, sf):
    return rounded(scoring.rank_params(scoring.fold_mean(records.scores(_rolled(spark, sf)))), "mape", "mae")


@query(
    "macro_mape",
    f"""{HELD}
SELECT CAST(param_id AS INTEGER) AS param_id, round(avg(mape), 4) AS mape, round(avg(mae), 4) AS mae,
       count(mape) AS n_series
FROM scores WHERE fold_id = 0 GROUP BY param_id""",
)
def macro_mape(spark, sf):
    means = scoring.macro_mean(records.scores(_held(spark, sf)), ["param_id"])
    return rounded(means, "mape", "mae")


@query("cv_tuning", f"{ROLLED}\nSELECT {MEAN_COLUMNS}, 'tuned' AS status FROM best")
def cv_tuning(spark, sf):
    chosen = records.choose(_rolled(spark, sf))
    return rounded(chosen.select("series", "param_id", "mape", "mae", "n_folds", "status"), "mape", "mae")


@query("holdout_tuning", f"{HELD}\nSELECT {MEAN_COLUMNS}, 'tuned' AS status FROM best")
def holdout_tuning(spark, sf):
    chosen = records.choose(_held(spark, sf))
    return rounded(chosen.select("series", "param_id", "mape", "mae", "n_folds", "status"), "mape", "mae")


@query(
    "refit_inputs",
    f"""{HELD}
SELECT p.series, strftime(p.ds, '%Y-%m') AS ds, p.y, CAST(b.param_id AS INTEGER) AS param_id, g.growth,
       g.seasonality_mode
FROM panel p JOIN best b USING (series) JOIN grid g ON g.param_id = b.param_id""",
)
def refit_inputs(spark, sf):
    """All history of each series with its winning parameters."""
    monthly = shared_panel(spark, sf)
    held = trend_month(split(monthly, HOLDOUT))
    best = records.choose(held).select("series", "param_id")
    sets = param_grid(spark, TREND_MONTH_GRID)
    return monthly.join(best.join(sets, "param_id"), "series").select(
        "series", "ds", "y", "param_id", "growth", "seasonality_mode"
    )


@query(
    "winner_validation",
    f"""{HELD}
SELECT p.series, strftime(p.ds, '%Y-%m') AS ds, CAST(p.param_id AS INTEGER) AS param_id, p.y, round(yhat, 4) AS yhat
FROM predicted p JOIN best b ON b.series = p.series AND b.param_id = p.param_id
WHERE fold_id = 0 AND part = 'val'""",
)
def winner_validation(spark, sf):
    rows = records.validation_rows(records.choose(_held(spark, sf)))
    return rounded(rows, "yhat").select("series", "ds", "param_id", "y", "yhat")


FINAL = f"""{HELD}, final AS (
  SELECT p.series, p.ds, p.param_id, b.mape, p.yhat FROM predicted p
  JOIN best b ON b.series = p.series AND b.param_id = p.param_id
  WHERE fold_id = -1 AND part = 'future')"""


def final_rows(spark, sf):
    return records.forecast_rows(records.choose(_held(spark, sf)))


@query(
    "final_forecast",
    f"""{FINAL}
SELECT series, strftime(ds, '%Y-%m') AS ds, CAST(param_id AS INTEGER) AS param_id, round(mape, 4) AS mape,
       round(yhat, 4) AS yhat FROM final""",
)
def final_forecast(spark, sf):
    return rounded(final_rows(spark, sf), "yhat", "mape").select("series", "ds", "param_id", "mape", "yhat")


def none_held(t, n):
    """Split scheme without validation folds; only the final fit remains."""
    return F.array().cast("array<struct<fold_id:int,start_idx:int,train_n:int,val_n:int>>")


def _refitted(spark, sf):
    return fit_trend_month(fold_rows(spark, sf, none_held, final=True), LINEAR)


@query(
    "trend_month_baseline",
    f"""{HELD}
SELECT DISTINCT series, CAST(month(ds) AS INTEGER) AS month, {sql.signed("slope", "slope", 6)},
       round(intercept, 4) AS intercept, {sql.signed("effect", "effect")}
FROM predicted WHERE fold_id = -1 AND param_id = 0""",
)
def trend_month_baseline(spark, sf):
    """Coefficients of the closed-form fit on all history."""
    fits = _refitted(spark, sf).groupBy("series", F.month("ds").alias("month")).agg(
        *[F.first(c).alias(c) for c in ("slope", "intercept", "effect")]
    )
    return rounded(rounded(fits, "intercept", "effect"), "slope", places=6)


@query(
    "direct_forecast",
    f"""{HELD}
SELECT series, strftime(ds, '%Y-%m') AS ds, round(yhat, 4) AS yhat
FROM predicted WHERE fold_id = -1 AND param_id = 0 AND part = 'future'""",
)
def direct_forecast(spark, sf):
    future = _refitted(spark, sf).where("part = 'future'")
    return rounded(future, "yhat").select("series", "ds", "yhat")


AR2 = f"""WITH RECURSIVE {sql.PANEL_5}, {sql.spine()}, known AS (
  SELECT series, ds, t, n, y, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b
  FROM indexed WINDOW w AS (PARTITION BY series ORDER BY indexed.t)), sums AS (
  SELECT series, CAST(count(*) AS DOUBLE) AS n, sum(a) AS sa, sum(b) AS sb, sum(a*a) AS saa, sum(a*b) AS sab,
         sum(b*b) AS sbb, sum(y) AS sy, sum(a*y) AS say, sum(b*y) AS sby
  FROM known WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY series), det AS (
  SELECT *, n*(saa*sbb - sab*sab) - sa*(sa*sbb - sab*sb) + sb*(sa*sab - saa*sb) AS d FROM sums), ar AS (
  SELECT series,
    (sy*(saa*sbb - sab*sab) - sa*(say*sbb - sab*sby) + sb*(say*sab - saa*sby)) / d AS const,
    (n*(say*sbb - sab*sby) - sy*(sa*sbb - sab*sb) + sb*(sa*sby - say*sb)) / d AS phi_1,
    (n*(saa*sby - say*sab) - sa*(sa*sby - say*sb) + sy*(sa*sab - saa*sb)) / d AS phi_2
  FROM det)"""


def _ar2(spark, sf):
    rows = panel.monthly_spine(shared_panel(spark, sf, panel_5))
    return rows, autoregression.ar2_fit(panel.ar_lags(rows, 2))


@query(
    "ar2_fit",
    f"{AR2}\nSELECT series, round(const, 4) AS const, round(phi_1, 6) AS phi_1, round(phi_2, 6) AS phi_2 FROM ar",
)
def ar2_fit(spark, sf):
    return rounded(rounded(_ar2(spark, sf)[1], "const"), "phi_1", "phi_2", places=6)


@query(
    "recursive_forecast",
    f"""{AR2}, steps AS (
  SELECT series, ds, 0 AS step, y AS a, (SELECT k.y FROM known k WHERE k.series = s.series AND k.t = s.t - 1) AS b
  FROM known s WHERE t = n - 1
  UNION ALL
  SELECT s.series, CAST(s.ds + INTERVAL 1 MONTH AS DATE), step + 1, const + phi_1 * a + phi_2 * b, a
  FROM steps s JOIN ar ON ar.series = s.series WHERE step < 12)
SELECT series, strftime(ds, '%Y-%m') AS ds, round(a, 4) AS yhat FROM steps WHERE step > 0""",
)
def recursive_forecast(spark, sf):
    rows, coefs = _ar2(spark, sf)
    newest = F.sort_array(F.collect_list(F.struct("t", "y")), asc=False)
    seeds = rows.where(F.col("t") >= F.col("n") - 2).groupBy("series").agg(
        F.transform(newest, lambda r: r["y"]).alias("seed"), F.max("ds").alias("last_ds")
    )
    stepped = autoregression.recursive_forecast(coefs.join(seeds, "series"), 12)
    points = stepped.select("series", "last_ds", F.posexplode("values").alias("at", "yhat"))
    return rounded(
        points.select("series", F.add_months("last_ds", F.col("at") + 1).alias("ds"), "yhat"), "yhat"
    )


PLUS_36 = "CAST(last_ds + INTERVAL 36 MONTH AS DATE)"
INTERVALS = f"""WITH {sql.PANEL_25}, {sql.spine(PLUS_36)}, {sql.rolling(*sql.ROLLING_36, final=True)}, {sql.TREND_MONTH},
{sql.bounds("predicted WHERE param_id = 0", f"{COVERAGE}", AROUND)}
SELECT p.series, strftime(p.ds, '%Y-%m') AS ds, round(yhat, 4) AS yhat, round(yhat - w.width, 4) AS lower,
       round(yhat + w.width, 4) AS upper
FROM predicted p LEFT JOIN widths w ON w.series = p.series AND w.step = p.t - p.n + 1
WHERE fold_id = -1 AND param_id = 0 AND part = 'future'"""


@query("interval_columns", INTERVALS)
def interval_columns(spark, sf):
    """Three years ahead with bounds that grow with the months ahead; the folds validate one year."""
    rows = panel.assign_folds(panel.extend_months(panel_25(spark, sf), F.add_months("last_ds", 36)), ROLLING, final=True)
    chosen = with_bounds(records.choose(trend_month(rows, LINEAR)))
    return rounded(records.forecast_rows(chosen).select("series", "ds", "yhat", "lower", "upper"), "yhat", "lower", "upper")
