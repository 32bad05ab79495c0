"""Forecasts of the regression and tree models."""

from pyspark.sql import functions as F

from lunario.fixed import DECOMPOSED_GRID, TREE_PENALTIES
from lunario.operators import panel
from lunario.operators.models import records
from lunario.operators.models.autoregression import decomposed_ar
from lunario.operators.models.least_squares import BASE_RIDGE
from lunario.operators.models.trees import LEAST_GAIN, choice, column_choices, panel_trees
from lunario.operators.models.trend_season import CHANGEPOINT_RIDGE, FOURIER_ORDER, trend_season
from lunario.plans import sqlparts as sql
from lunario.plans.frames import amounts_5, panel_5
from lunario.plans.registry import query, rounded

TREND_GRID = {"growth": ["linear"], "n_changepoints": [10], "seasonality_mode": ["additive", "multiplicative"]}
AR_GRID = {"growth": ["discontinuous", "linear"], "n_changepoints": [1], "seasonality_mode": ["additive"]}
STUMP_GRID = {"colsample_bytree": [0.7, 1.0], "learning_rate": [0.5], "max_depth": [1], "n_estimators": [1, 2]}


def fold_rows(spark, sf, frame=panel_5):
    indexed = panel.extend_months(frame(spark, sf), F.add_months("last_ds", 12))
    return panel.assign_folds(indexed, panel.holdout_folds(12), final=True)


def _forecast(fold_records):
    rows = records.forecast_rows(records.choose(fold_records))
    return rounded(rows.select("series", "ds", "param_id", "mape", "yhat"), "mape", "yhat")


# -- check SQL ---------------------------------------------------------------

ROWS = f"{sql.PANEL_5}, {sql.spine(sql.PLUS_12)}, {sql.holdout(12, final=True)}"
SCALED = """scaled AS (
  SELECT r.*, avg(CASE WHEN part = 'train' THEN abs(y) END) OVER (PARTITION BY series, fold_id) AS scale,
         last_value(y IGNORE NULLS) OVER (PARTITION BY series, fold_id ORDER BY r.t) AS y_known,
         (t - start_idx) / CAST(train_n - 1 AS DOUBLE) AS s
  FROM fold_rows r)"""


def _season_sql():
    angle = "month(ds) * 0.5235987755982988"
    cosines = [f"cos({angle} * {k})" for k in range(1, FOURIER_ORDER + 1)]
    return cosines + [f"sin({angle} * {k})" for k in range(1, FOURIER_ORDER)]


def _knots_sql(points):
    return [f"{0.8 * j / (points + 1)!r}" for j in range(1, points + 1)]


def _hinges_sql(points):
    return [f"greatest(s - {k}, 0)" for k in _knots_sql(points)]


CHOSEN = f"""{sql.SCORES}, {sql.MEANS}
SELECT p.series, strftime(p.ds, '%Y-%m') AS ds, CAST(p.param_id AS INTEGER) AS param_id, round(b.mape, 4) AS mape,
       round(p.yhat, 4) AS yhat
FROM predicted p JOIN best b ON b.series = p.series AND b.param_id = p.param_id
WHERE p.fold_id = -1 AND p.part = 'future'"""

TREND_WIDTH = 2 + 10
TREND_TERMS = ["CAST(1 AS DOUBLE)", "s", *_hinges_sql(10), *_season_sql()]
TREND_RIDGE = [BASE_RIDGE] * 2 + [BASE_RIDGE + CHANGEPOINT_RIDGE] * 10 + [BASE_RIDGE] * 11


def trend_chain(multiplicative=True):
    """CTEs from the fold rows to the ``predicted`` rows of trend and season, additive as set 0."""
    ratio = """
  UNION ALL
  SELECT v.series, v.fold_id, v.ds, v.part, v.y, v.t, v.start_idx, v.train_n, v.n, 1, v.trend * r.ratio * v.scale FROM valued v
  JOIN ratios r ON r.series = v.series AND r.fold_id = v.fold_id AND r.m = month(v.ds)"""
    return f"""{SCALED}, design AS (
  SELECT *, 0 AS param_id, [{", ".join(TREND_TERMS)}] AS x, y / scale AS v FROM scaled), training AS (
  SELECT series, fold_id, param_id, x, v FROM design WHERE part = 'train' AND v IS NOT NULL),
{sql.solved("training", len(TREND_TERMS), TREND_RIDGE)}, valued AS (
  SELECT d.* EXCLUDE (param_id), list_dot_product(d.x, c.coef) AS fit,
         list_dot_product(d.x[1:{TREND_WIDTH}], c.coef[1:{TREND_WIDTH}]) AS trend
  FROM design d JOIN coefs c ON c.series = d.series AND c.fold_id = d.fold_id), ratios AS (
  SELECT series, fold_id, month(ds) AS m, avg(v / trend) AS ratio FROM valued
  WHERE part = 'train' AND v IS NOT NULL GROUP BY 1, 2, 3), predicted AS (
  SELECT series, fold_id, ds, part, y, t, start_idx, train_n, n, 0 AS param_id, fit * scale AS yhat FROM valued{ratio if multiplicative else ""})"""


TREND_SEASON_SQL = f"WITH RECURSIVE {ROWS}, {trend_chain()}, {CHOSEN}"


@query("trend_season_forecast", TREND_SEASON_SQL)
def trend_season_forecast(spark, sf):
    """Trend with ten changepoints and yearly season, additive or multiplicative."""
    return _forecast(trend_season(fold_rows(spark, sf), TREND_GRID))


def _step(coef, terms, lags):
    """SQL of one recursive step: known terms plus lag coefficients times ``h`` (newest first)."""
    known = f"list_dot_product({terms}, {coef}[1:len({terms})])"
    return known + "".join(f" + {coef}[len({terms}) + {k}] * h[{k}]" for k in range(1, lags + 1))


AR_TERMS = [
    "CAST(1 AS DOUBLE)", "s", *_hinges_sql(1),
    f"CASE WHEN g.param_id = 0 AND s >= {_knots_sql(1)[0]} THEN 1 ELSE 0 END", *_season_sql(),
]
AR_RIDGE = [BASE_RIDGE] * 2 + [BASE_RIDGE + CHANGEPOINT_RIDGE] * 2 + [BASE_RIDGE] * 13


def linear_ar_design(points):
    """(terms, ridge) of a linear trend with ``points`` changepoints, season and two lags."""
    terms = ["CAST(1 AS DOUBLE)", "s", *_hinges_sql(points), *_season_sql()]
    return terms, [BASE_RIDGE] * 2 + [BASE_RIDGE + CHANGEPOINT_RIDGE] * points + [BASE_RIDGE] * 13


def ar_chain(terms, ridge, sets):
    """CTEs from the fold rows to the ``predicted`` rows of trend, season and two lags."""
    return f"""{SCALED}, lagged AS (
  SELECT *, lag(y_known, 1) OVER w / scale AS lag_1, lag(y_known, 2) OVER w / scale AS lag_2
  FROM scaled WINDOW w AS (PARTITION BY series, fold_id ORDER BY scaled.t)), design AS (
  SELECT l.*, g.param_id, [{", ".join(terms)}] AS xt, y / scale AS v
  FROM lagged l CROSS JOIN (VALUES {", ".join(f"({k})" for k in range(sets))}) AS g(param_id)), training AS (
  SELECT series, fold_id, param_id, list_concat(xt, [lag_1, lag_2]) AS x, v FROM design
  WHERE part = 'train' AND v IS NOT NULL AND lag_1 IS NOT NULL AND lag_2 IS NOT NULL),
{sql.solved("training", len(terms) + 2, ridge)}, walk AS (
  SELECT series, fold_id, param_id, t, [y_known / scale, lag_1] AS h FROM design
  WHERE part = 'train' AND t = start_idx + train_n - 1
  UNION ALL
  SELECT d.series, d.fold_id, d.param_id, d.t, [{_step("c.coef", "d.xt", 2)}, h[1]]
  FROM walk w JOIN design d ON d.series = w.series AND d.fold_id = w.fold_id AND d.param_id = w.param_id AND d.t = w.t + 1
  JOIN coefs c ON c.series = w.series AND c.fold_id = w.fold_id AND c.param_id = w.param_id), predicted AS (
  SELECT d.series, d.fold_id, d.param_id, d.ds, d.part, d.y, d.t, d.start_idx, d.train_n, d.n, w.h[1] * d.scale AS yhat
  FROM walk w JOIN design d ON d.series = w.series AND d.fold_id = w.fold_id AND d.param_id = w.param_id AND d.t = w.t
  WHERE d.part <> 'train')"""


AR_SQL = f"WITH RECURSIVE {ROWS}, {ar_chain(AR_TERMS, AR_RIDGE, 2)}, {CHOSEN}"


@query("trend_season_ar_forecast", AR_SQL)
def trend_season_ar_forecast(spark, sf):
    """The same with two lags, predicted month by month."""
    return _forecast(trend_season(fold_rows(spark, sf), AR_GRID, lags=2))


def decomposed_sql(lags, final, source=None):
    """Check SQL of the decomposed autoregression up to ``predicted``; ``source``: CTEs up to the fold rows."""
    source = source or f"{sql.PANEL_5}, {sql.spine(sql.PLUS_12)}, {sql.holdout(12, final=final)}"
    most = max(lags)
    sets = ", ".join(f"({i}, {n})" for i, n in enumerate(lags))
    lag_terms = ", ".join(f"CASE WHEN g.lags >= {k} THEN lag_{k} ELSE 0 END" for k in range(1, most + 1))
    lag_columns = ", ".join(f"lag(known, {k}) OVER w AS lag_{k}" for k in range(1, most + 1))
    seeds = ", ".join(["known", *[f"lag_{k}" for k in range(1, most)]])
    step = "c.coef[1]" + "".join(f" + c.coef[{k + 1}] * h[{k}]" for k in range(1, most + 1))
    return f"""{source}, {sql.DECOMPOSED}, scaled AS (
  SELECT *, avg(CASE WHEN part = 'train' THEN abs(z) END) OVER (PARTITION BY series, fold_id) AS scale
  FROM parts), lagged AS (
  SELECT *, {lag_columns} FROM (SELECT *, coalesce(z / scale, 0) AS known FROM scaled) q
  WINDOW w AS (PARTITION BY series, fold_id ORDER BY q.t)), design AS (
  SELECT l.*, g.param_id, g.lags, [CAST(1 AS DOUBLE), {lag_terms}] AS x, z / scale AS v
  FROM lagged l CROSS JOIN (VALUES {sets}) AS g(param_id, lags)), training AS (
  SELECT series, fold_id, param_id, x, v FROM design
  WHERE part = 'train' AND v IS NOT NULL AND t >= start_idx + lags),
{sql.solved("training", most + 1, [BASE_RIDGE] * (most + 1))}, walk AS (
  SELECT series, fold_id, param_id, t, [{seeds}] AS h FROM design
  WHERE part = 'train' AND t = start_idx + train_n - 1
  UNION ALL
  SELECT w.series, w.fold_id, w.param_id, w.t + 1, list_prepend({step}, h[1:{most - 1}])
  FROM walk w JOIN coefs c ON c.series = w.series AND c.fold_id = w.fold_id AND c.param_id = w.param_id
  WHERE EXISTS (SELECT 1 FROM lagged l WHERE l.series = w.series AND l.fold_id = w.fold_id AND l.t = w.t + 1)),
  predicted AS (
  SELECT l.series, l.fold_id, w.param_id, l.ds, l.part, l.y, l.t, l.start_idx, l.train_n, l.n, w.h[1] * l.scale + l.trend + l.season AS yhat
  FROM walk w JOIN lagged l ON l.series = w.series AND l.fold_id = w.fold_id AND l.t = w.t
  WHERE l.part <> 'train')"""


@query("decomposed_ar_forecast", f"WITH RECURSIVE {decomposed_sql(DECOMPOSED_GRID["lags"], final=True)}, {CHOSEN}")
def decomposed_ar_forecast(spark, sf):
    """Detrend, deseason, autoregress on 2 to 18 months, revert."""
    return _forecast(decomposed_ar(fold_rows(spark, sf), DECOMPOSED_GRID))


def _soft_sql(total):
    return f"sign({total}) * greatest(abs({total}) - {TREE_PENALTIES['reg_alpha']!r}, 0)"


def _stump_sql(tree):
    """Tree ``tree`` (from 0) of depth 1 on top of the predictions p{tree}."""
    drawn = [(share, column_choices(share)) for share in STUMP_GRID["colsample_bytree"]]
    allowed = ", ".join(f"({share!r}, {f})" for share, sets in drawn for f in sets[choice(tree, len(sets))])
    sides = [("gl", "hl"), ("(gt - gl)", "(ht - hl)"), ("gt", "ht")]
    left, right, own = (f"power({_soft_sql(g)}, 2) / {h}" for g, h in sides)
    weights = [f"-{_soft_sql(g)} / {h}" for g, h in sides]
    return f"""sums{tree} AS (
  SELECT series, fold_id, share, b.f, b.v, sum(CASE WHEN x.v < b.v THEN p.yhat - p.y ELSE 0 END) AS gl,
         count(CASE WHEN x.v < b.v THEN 1 END) AS hl, sum(p.yhat - p.y) AS gt, count(*) AS ht
  FROM p{tree} p JOIN features x USING (series, fold_id, ds) JOIN bounds b USING (series, fold_id, f)
  WHERE p.part = 'train' AND p.y IS NOT NULL GROUP BY ALL), gains{tree} AS (
  SELECT *, {left} + {right} - {own} AS gain FROM sums{tree} JOIN (VALUES {allowed}) a(share, f) USING (share, f)
  WHERE hl >= 1 AND ht - hl >= 1), best{tree} AS (
  SELECT *, row_number() OVER (PARTITION BY series, fold_id, share ORDER BY gain DESC, f, v) AS place FROM gains{tree}
  WHERE gain > {LEAST_GAIN!r} AND gain >= {TREE_PENALTIES['gamma']!r}), roots{tree} AS (
  SELECT DISTINCT series, fold_id, share, gt, ht FROM sums{tree}), p{tree + 1} AS (
  SELECT p.* REPLACE (p.yhat + {STUMP_GRID["learning_rate"][0]!r} * CASE WHEN b.f IS NULL THEN (
           SELECT {weights[2]} FROM roots{tree} r WHERE r.series = p.series AND r.fold_id = p.fold_id AND r.share = p.share
             LIMIT 1) WHEN x.v < b.v THEN {weights[0]} ELSE {weights[1]} END AS yhat)
  FROM p{tree} p LEFT JOIN best{tree} b ON b.series = p.series AND b.fold_id = p.fold_id AND b.share = p.share AND b.place = 1
  LEFT JOIN features x ON x.series = p.series AND x.fold_id = p.fold_id AND x.ds = p.ds AND x.f = b.f)"""


STUMPS_SQL = f"""WITH {sql.AMOUNTS_5}, {sql.spine(sql.PLUS_12)}, {sql.holdout(12, final=True)}, features AS (
  SELECT series, fold_id, ds, part, y, f.f AS f, [month(ds), quarter(ds), year(ds)][f.f + 1] AS v
  FROM fold_rows, range(0, 3) f(f)), bounds AS (
  SELECT DISTINCT series, fold_id, f, v FROM features WHERE part = 'train' AND y IS NOT NULL), p0 AS (
  SELECT series, fold_id, ds, part, y, s.share,
         avg(CASE WHEN part = 'train' THEN y END) OVER (PARTITION BY series, fold_id, s.share) AS yhat
  FROM fold_rows, (VALUES {", ".join(f"({s!r})" for s in STUMP_GRID["colsample_bytree"])}) s(share)),
{_stump_sql(0)}, {_stump_sql(1)}, predicted AS (
  SELECT series, fold_id, ds, part, y, yhat, CASE WHEN share = {STUMP_GRID["colsample_bytree"][0]!r} THEN 0 ELSE 2 END + n AS param_id
  FROM (SELECT *, 0 AS n FROM p1 UNION ALL SELECT *, 1 FROM p2)), {CHOSEN}"""


@query("tree_stumps", STUMPS_SQL)
def tree_stumps(spark, sf):
    """One and two boosted trees of depth 1, on all and on two of the features."""
    return _forecast(panel_trees(fold_rows(spark, sf, amounts_5), STUMP_GRID))


@query("panel_trees")
def panel_trees_forecast(spark, sf):
    """Boosted trees over the whole grid; beyond what SQL can express (see ``tree_stumps``)."""
    return _forecast(panel_trees(fold_rows(spark, sf, amounts_5)))
