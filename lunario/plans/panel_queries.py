"""Series profiles, calendars, lags, splits and grids."""

from pyspark.sql import functions as F

from lunario.fixed import TREE_GRID, TREND_SEASON_GRID_FULL
from lunario.functions import calendar
from lunario.operators import grid, panel
from lunario.operators.decompose import deseasonalize, detrend_quadratic, revert_transforms
from lunario.operators.scoring import score
from lunario.operators.models.trend_month import fit_trend_month
from lunario.plans import sqlparts as sql
from lunario.plans.frames import masked_panel, national, panel_5, panel_25, wide_5
from lunario.plans.registry import query, rounded
from lunario.session import written


@query(
    "series_profile",
    f"""WITH {sql.PANEL_25}
SELECT series, count(*) AS months, count(y) AS observed, CAST(min(year(ds)) AS INTEGER) AS first_year,
       strftime(max(ds), '%Y-%m') AS last_ds
FROM panel GROUP BY series""",
)
def series_profile(spark, sf):
    return panel.series_profile(panel_25(spark, sf))


@query(
    "time_index",
    f"""WITH {sql.PANEL_25}, {sql.INDEXED}
SELECT series, strftime(ds, '%Y-%m') AS ds, CAST(t AS INTEGER) AS t, CAST(n AS INTEGER) AS n, y FROM indexed""",
)
def time_index(spark, sf):
    return panel.time_index(panel_25(spark, sf)).select("series", "ds", "t", "n", "y")


@query(
    "chronological",
    f"""WITH {sql.PANEL_5}
SELECT series, strftime(ds, '%Y-%m') AS ds, y FROM panel ORDER BY series, panel.ds""",
)
def chronological(spark, sf):
    return panel_5(spark, sf).orderBy("series", "ds")


@query(
    "melt_panel",
    f"""WITH {sql.PANEL_5}
SELECT s.series, strftime(d.ds, '%Y-%m') AS ds, p.y
FROM (SELECT DISTINCT ds FROM panel) d CROSS JOIN (SELECT DISTINCT series FROM panel) s
LEFT JOIN panel p ON p.ds = d.ds AND p.series = s.series""",
)
def melt_panel(spark, sf):
    return panel.melt_panel(wide_5(spark, sf))


@query(
    "monthly_spine",
    f"""WITH {sql.PANEL_25}, {sql.spine()}
SELECT series, strftime(ds, '%Y-%m') AS ds, CAST(t AS INTEGER) AS t, y, is_gap FROM indexed""",
)
def monthly_spine(spark, sf):
    return panel.monthly_spine(panel_25(spark, sf)).select("series", "ds", "t", "y", "is_gap")


@query(
    "calendar_features",
    f"""WITH {sql.NATIONAL}
SELECT strftime(ds, '%Y-%m') AS ds, CAST(month(ds) AS INTEGER) AS month, CAST(quarter(ds) AS INTEGER) AS quarter,
       CAST(year(ds) AS INTEGER) AS year, y, amount
FROM national""",
)
def calendar_features(spark, sf):
    return calendar.calendar_features(national(spark, sf)).drop("series")


def _last(spark, sf):
    return panel_25(spark, sf).groupBy("series").agg(F.max("ds").alias("last_ds"))


LAST = f"WITH {sql.PANEL_25}, last AS (SELECT series, max(ds) AS last_ds FROM panel GROUP BY series)"


@query(
    "horizon_months",
    f"""{LAST}
SELECT series, CAST(datediff('month', last_ds, DATE '2004-12-01') AS INTEGER) AS horizon FROM last""",
)
def horizon_months(spark, sf):
    end = F.lit("2004-12-01").cast("date")
    return _last(spark, sf).select("series", calendar.horizon_months(F.col("last_ds"), end).alias("horizon"))


@query(
    "default_horizon",
    f"""{LAST}
SELECT series, (year(last_ds) + 3) || '-12' AS horizon_end,
       CAST(datediff('month', last_ds, make_date(year(last_ds) + 3, 12, 1)) AS INTEGER) AS horizon FROM last""",
)
def default_horizon(spark, sf):
    end = calendar.default_horizon(F.col("last_ds"))
    return _last(spark, sf).select(
        "series", end.alias("horizon_end"), calendar.horizon_months(F.col("last_ds"), end).alias("horizon")
    )


@query(
    "next_month",
    f"""WITH {sql.PANEL_25}
SELECT series, strftime(ds, '%Y-%m') AS ds, strftime(ds + INTERVAL 1 MONTH, '%Y-%m') AS next_ds FROM panel""",
)
def next_month(spark, sf):
    return panel_25(spark, sf).select("series", "ds", calendar.next_month(F.col("ds")).alias("next_ds"))


@query(
    "future_frame",
    f"""{LAST}
SELECT series, strftime(unnest(generate_series(last_ds + INTERVAL 1 MONTH, TIMESTAMP '2002-12-01', INTERVAL 1 MONTH)),
                        '%Y-%m') AS ds
FROM last""",
)
def future_frame(spark, sf):
    end = F.lit("2002-12-01").cast("date")
    return calendar.future_frame(_last(spark, sf), end).select("series", "ds")


@query(
    "future_panel",
    f"""{LAST}, future AS (
  SELECT series, unnest(generate_series(last_ds + INTERVAL 1 MONTH,
         CAST(make_date(year(last_ds) + 3, 12, 1) AS TIMESTAMP), INTERVAL 1 MONTH)) AS ds FROM last)
SELECT series, strftime(ds, '%Y-%m') AS ds, CAST(month(ds) AS INTEGER) AS month,
       CAST(quarter(ds) AS INTEGER) AS quarter, CAST(year(ds) AS INTEGER) AS year
FROM future""",
)
def future_panel(spark, sf):
    end = calendar.default_horizon(F.col("last_ds"))
    future = calendar.future_frame(_last(spark, sf), end).select("series", "ds")
    return calendar.calendar_features(future)


LAG_COLUMNS = ", ".join(f"lag(y, {k}) OVER w AS lag_{k}" for k in range(1, 7))


@query(
    "ar_lags",
    f"""WITH {sql.PANEL_25}, {sql.spine()}
SELECT series, strftime(ds, '%Y-%m') AS ds, y, {LAG_COLUMNS}
FROM indexed WINDOW w AS (PARTITION BY series ORDER BY indexed.ds)""",
)
def ar_lags(spark, sf):
    lagged = panel.ar_lags(panel.monthly_spine(panel_25(spark, sf)), 6)
    return lagged.select("series", "ds", "y", *[f"lag_{k}" for k in range(1, 7)])


@query(
    "holdout_split",
    f"""WITH {sql.PANEL_25}, {sql.INDEXED}
SELECT series, strftime(ds, '%Y-%m') AS ds, y, CASE WHEN t >= n - 12 THEN 'val' ELSE 'train' END AS part
FROM indexed""",
)
def holdout_split(spark, sf):
    return panel.holdout_split(panel.with_span(panel_25(spark, sf)), 12).select("series", "ds", "y", "part")


@query(
    "holdout_context",
    f"""WITH {sql.PANEL_25}, {sql.INDEXED}
SELECT series, strftime(ds, '%Y-%m') AS ds, y, t < n - 12 AS is_context FROM indexed WHERE t >= n - 14""",
)
def holdout_context(spark, sf):
    marked = panel.holdout_split(panel.with_span(panel_25(spark, sf)), 12, context=2)
    return marked.where("part = 'val' or is_context").select("series", "ds", "y", "is_context")


@query(
    "fill_missing",
    f"""WITH {sql.MASKED.replace("% 10 = 0", "% 10 = 0 OR year(ds) = 1997")}, {sql.spine()}, {sql.filled(sql.holdout(12))}
SELECT series, strftime(ds, '%Y-%m') AS ds, part, fill, round(y, 4) AS y FROM fold_rows""",
)
def fill_missing(spark, sf):
    """Single missing months and a missing year: interpolated, or the mean of the months around."""
    gappy = masked_panel(spark, sf).withColumn("y", F.when(F.year("ds") != 1997, F.col("y")))
    rows = panel.assign_folds(panel.extend_months(gappy), panel.holdout_folds(12))
    return rounded(panel.fill_missing(rows).select("series", "ds", "part", "fill", "y"), "y")


@query(
    "far_months",
    f"""WITH {sql.PANEL_5}, firsts AS (
  SELECT series, min(ds) AS first_ds FROM panel GROUP BY 1)
SELECT series, strftime(ds, '%Y-%m') AS ds, y, CAST(NULL AS VARCHAR) AS reason FROM panel
UNION ALL
SELECT series, strftime(first_ds - INTERVAL (k) YEAR, '%Y-%m'), 1, CASE WHEN k > 10 THEN 'far_month' END
FROM firsts, (VALUES (1000), (21), (10)) AS away(k)""",
)
def far_months(spark, sf):
    """Mistyped years beside real months: 1,000 and 21 years away; ten are still near."""
    monthly = written(panel_5(spark, sf), "panel")
    first = monthly.groupBy("series").agg(F.min("ds").alias("ds"))
    away = F.explode(F.array(F.lit(1000), F.lit(21), F.lit(10))).alias("years")
    odd = first.select("series", "ds", away).select("series", F.add_months("ds", -12 * F.col("years")).alias("ds"), F.lit(1.0).alias("y"))
    return panel.far_months(monthly.unionByName(odd))


@query(
    "rolling_folds",
    f"""WITH {sql.PANEL_25}, {sql.spine()}, {sql.rolling(36, 12, 12)}
SELECT series, strftime(ds, '%Y-%m') AS ds, CAST(fold_id AS INTEGER) AS fold_id,
       CAST(start_idx AS INTEGER) AS start_idx, CAST(train_n AS INTEGER) AS train_n,
       CAST(val_n AS INTEGER) AS val_n, part, y
FROM fold_rows""",
)
def rolling_folds(spark, sf):
    rows = panel.assign_folds(panel.monthly_spine(panel_25(spark, sf)), panel.rolling_folds(36, 12, 12))
    return rows.select("series", "ds", "fold_id", "start_idx", "train_n", "val_n", "part", "y")


@query(
    "param_grid",
    f"""WITH {sql.PANEL_25}
SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY cf, lr, md, ne) - 1 AS INTEGER) AS param_id,
       CAST(cf AS DOUBLE) AS colsample_bytree, CAST(lr AS DOUBLE) AS learning_rate,
       md AS max_depth, ne AS n_estimators
FROM (SELECT DISTINCT series FROM panel)
CROSS JOIN (VALUES (0.4), (0.7), (1.0)) AS a(cf) CROSS JOIN (VALUES (0.01), (0.1), (0.5)) AS b(lr)
CROSS JOIN (VALUES (3), (5), (10)) AS c(md) CROSS JOIN (VALUES (500), (1000), (2000)) AS d(ne)""",
)
def param_grid(spark, sf):
    series = panel_25(spark, sf).groupBy("series").agg(F.count("y").alias("months"))
    return grid.with_params(series, TREE_GRID).drop("months")


@query(
    "tuning_grid",
    f"""WITH {sql.PANEL_25}, spans AS (
  SELECT series, datediff('month', min(ds), max(ds)) + 1 AS n FROM panel GROUP BY series)
SELECT series, CAST(k AS INTEGER) AS fold_id, CAST(k * 12 AS INTEGER) AS start_idx, g.growth, c.k_points AS n_changepoints,
       m.mode AS seasonality_mode, CAST(g.i * 6 + c.i * 2 + m.i AS INTEGER) AS param_id
FROM spans JOIN range(0, 1000) AS f(k) ON k * 12 + 48 <= n
CROSS JOIN (VALUES (0, 'linear'), (1, 'discontinuous')) AS g(i, growth)
CROSS JOIN (VALUES (0, 10), (1, 20), (2, 50)) AS c(i, k_points)
CROSS JOIN (VALUES (0, 'additive'), (1, 'multiplicative')) AS m(i, mode)""",
)
def tuning_grid(spark, sf):
    spans = panel_25(spark, sf).groupBy("series").agg(
        calendar.horizon_months(F.min("ds"), F.max("ds")).alias("last_t")
    )
    spans = spans.select("series", (F.col("last_t") + 1).alias("n"))
    fits = grid.tuning_grid(spans, TREND_SEASON_GRID_FULL, 36, 12, 12)
    return fits.select(
        "series", "fold_id", "start_idx", "growth", "n_changepoints", "seasonality_mode", "param_id"
    )


@query(
    "masked_scores",
    f"""WITH {sql.MASKED}, {sql.spine(sql.PLUS_12)}, {sql.holdout(12)}, {sql.TREND_MONTH}, {sql.SCORES}
SELECT series, CAST(param_id AS INTEGER) AS param_id, n, round(mape, 4) AS mape, round(mae, 4) AS mae FROM scores""",
)
def masked_scores(spark, sf):
    indexed = panel.extend_months(masked_panel(spark, sf), F.add_months("last_ds", 12))
    rows = panel.assign_folds(indexed, panel.holdout_folds(12))
    predicted = fit_trend_month(rows).where("part = 'val'")
    return rounded(
        score(predicted, ["series", "param_id"]).select("series", "param_id", "n", "mape", "mae"), "mape", "mae"
    )


def _decomposed(spark, sf):
    indexed = panel.extend_months(panel_25(spark, sf), F.add_months("last_ds", 12))
    return deseasonalize(detrend_quadratic(indexed))


DECOMPOSE = f"WITH {sql.PANEL_25}, {sql.spine(sql.PLUS_12)}, {sql.ALL_TRAIN}, {sql.DECOMPOSED}"


@query(
    "detrend_quadratic",
    f"""{DECOMPOSE}
SELECT series, strftime(ds, '%Y-%m') AS ds, round(c0, 4) AS c0, {sql.signed("c1", "c1", 6)},
       {sql.signed("c2", "c2", 6)}, round(trend, 4) AS trend, {sql.signed("resid", "resid")}
FROM parts WHERE ds <= last_ds""",
)
def detrend(spark, sf):
    rows = _decomposed(spark, sf).where(~F.col("is_future"))
    rows = rounded(rounded(rows, "c0", "trend", "resid"), "c1", "c2", places=6)
    return rows.select("series", "ds", "c0", "c1", "c2", "trend", "resid")


@query(
    "deseasonalize",
    f"""{DECOMPOSE}
SELECT series, strftime(ds, '%Y-%m') AS ds, {sql.signed("season", "season")}, {sql.signed("z", "z")}
FROM parts WHERE ds <= last_ds""",
)
def deseason(spark, sf):
    rows = _decomposed(spark, sf).where(~F.col("is_future"))
    return rounded(rows, "season", "z").select("series", "ds", "season", "z")


@query(
    "revert_transforms",
    f"""{DECOMPOSE}
SELECT series, strftime(ds, '%Y-%m') AS ds, round(coalesce(z, 0) + season + trend, 4) AS yhat FROM parts""",
)
def revert(spark, sf):
    """History comes back as it was; future months get season and trend."""
    known = _decomposed(spark, sf).withColumn("z", F.coalesce("z", F.lit(0.0)))
    return rounded(revert_transforms(known), "yhat").select("series", "ds", "yhat")
