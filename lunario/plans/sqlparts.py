"""Pieces of the check SQL shared by several queries."""

from lunario.fixed import FILL_GAP, FILL_WINDOW

NATIONAL = """national AS (
  SELECT 'total' AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         CAST(count(*) AS DOUBLE) AS y,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) AS amount
  FROM orders GROUP BY 1, 2)"""

PANEL_5 = """panel AS (
  SELECT c_mktsegment AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         CAST(count(*) AS DOUBLE) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2)"""

AMOUNTS_5 = """panel AS (
  SELECT c_mktsegment AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2)"""

PANEL_25 = """panel AS (
  SELECT n_name AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         CAST(count(*) AS DOUBLE) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""

MASKED = PANEL_5.replace("panel AS", "full_panel AS") + """, panel AS (
  SELECT series, ds,
         CASE WHEN (month(ds) * 7 + length(series)) % 10 = 0 THEN NULL ELSE y END AS y
  FROM full_panel)"""

INDEXED = """indexed AS (
  SELECT series, ds, y,
         datediff('month', min(ds) OVER w, ds) AS t,
         datediff('month', min(ds) OVER w, max(ds) OVER w) + 1 AS n,
         max(ds) OVER w AS last_ds
  FROM panel WINDOW w AS (PARTITION BY series))"""


def spine(end=None):
    """Rows of every month up to the last (or ``end``) with t, n, y."""
    stop = "last_ds" if end is None else f"greatest({end}, last_ds)"
    return f"""spans AS (
  SELECT series, min(ds) AS first_ds, max(ds) AS last_ds,
         datediff('month', min(ds), max(ds)) + 1 AS n
  FROM panel GROUP BY series), months AS (
  SELECT series, first_ds, last_ds, n,
         CAST(unnest(generate_series(first_ds, {stop}, INTERVAL 1 MONTH)) AS DATE) AS ds
  FROM spans), indexed AS (
  SELECT m.series, m.ds, p.y, m.first_ds, m.last_ds, m.n,
         datediff('month', m.first_ds, m.ds) AS t,
         p.ds IS NULL AND m.ds <= m.last_ds AS is_gap
  FROM months m LEFT JOIN panel p ON p.series = m.series AND p.ds = m.ds)"""


def signed(expression, name, places=4):
    """Rounded value without a negative zero."""
    return f"CASE WHEN abs({expression}) < 0.5e-{places} THEN 0 ELSE round({expression}, {places}) END AS {name}"


PLUS_12 = "CAST(last_ds + INTERVAL 12 MONTH AS DATE)"


def holdout(val=12, final=False):
    """Fold rows of a holdout split (fold 0) and the final fit (fold -1)."""
    last = (
        """ UNION ALL
  SELECT *, -1 AS fold_id, 0 AS start_idx, n AS train_n, 0 AS val_n,
         CASE WHEN t < n THEN 'train' ELSE 'future' END AS part FROM indexed"""
        if final
        else ""
    )
    return f"""fold_rows AS (
  SELECT *, 0 AS fold_id, 0 AS start_idx, n - {val} AS train_n, {val} AS val_n,
         CASE WHEN t < n - {val} THEN 'train' ELSE 'val' END AS part
  FROM indexed WHERE t < n AND n > {val}{last})"""


def filled(rows):
    """``rows`` (CTEs up to the fold rows) with missing training values filled in; ``fill`` says how."""
    return rows.replace("fold_rows AS (", "plain_rows AS (", 1) + f""", around AS (
  SELECT *, last_value(CASE WHEN known IS NOT NULL THEN t END IGNORE NULLS) OVER back AS t0,
         last_value(known IGNORE NULLS) OVER back AS y0,
         first_value(CASE WHEN known IS NOT NULL THEN t END IGNORE NULLS) OVER ahead AS t1,
         first_value(known IGNORE NULLS) OVER ahead AS y1, avg(known) OVER near AS near_mean
  FROM (SELECT *, CASE WHEN part = 'train' THEN y END AS known FROM plain_rows) q
  WINDOW back AS (PARTITION BY series, fold_id ORDER BY t),
         ahead AS (PARTITION BY series, fold_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         near AS (PARTITION BY series, fold_id ORDER BY t RANGE BETWEEN {FILL_WINDOW} PRECEDING AND {FILL_WINDOW} FOLLOWING)),
  fills AS (
  SELECT *, CASE WHEN y IS NOT NULL THEN 'observed' WHEN part = 'train' AND t1 - t0 - 1 <= {FILL_GAP} THEN 'linear'
                 WHEN part = 'train' AND near_mean IS NOT NULL THEN 'mean' END AS fill FROM around), fold_rows AS (
  SELECT * EXCLUDE (known, t0, y0, t1, y1, near_mean) REPLACE (CASE fill WHEN 'linear' THEN y0 + (y1 - y0) * (t - t0) / (t1 - t0)
                                WHEN 'mean' THEN near_mean ELSE y END AS y)
  FROM fills)"""


def rolling(train, val, step, final=False):
    last = (
        """ UNION ALL
  SELECT i.*, -1 AS fold_id, 0 AS start_idx, n AS train_n, 0 AS val_n,
         CASE WHEN t < n THEN 'train' ELSE 'future' END AS part FROM indexed i"""
        if final
        else ""
    )
    return f"""fold_rows AS (
  SELECT i.*, f.k AS fold_id, f.k * {step} AS start_idx, {train} AS train_n, {val} AS val_n,
         CASE WHEN t < f.k * {step} + {train} THEN 'train' ELSE 'val' END AS part
  FROM indexed i JOIN range(0, 1000) AS f(k)
    ON f.k * {step} <= t AND t < f.k * {step} + {train + val} AND f.k * {step} + {train + val} <= n
       AND t < n{last})"""


# Closed-form model on fold_rows: predictions of every row and parameter set.
TREND_MONTH = """grid AS (
  SELECT * FROM (VALUES (0, 'linear', 'additive'), (1, 'linear', 'multiplicative'),
                        (2, 'flat', 'additive'), (3, 'flat', 'multiplicative'))
           AS g(param_id, growth, seasonality_mode)), lines_fit AS (
  SELECT series, fold_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, avg(y) AS level
  FROM fold_rows WHERE part = 'train' AND y IS NOT NULL GROUP BY 1, 2), trended AS (
  SELECT r.*, g.*, c.slope, c.intercept, c.level,
         CASE WHEN growth = 'linear' THEN intercept + slope * t ELSE level END AS trend
  FROM fold_rows r JOIN lines_fit c USING (series, fold_id) CROSS JOIN grid g), effects AS (
  SELECT series, fold_id, param_id, month(ds) AS m,
         avg(CASE WHEN seasonality_mode = 'additive' THEN y - trend ELSE y / trend END) AS effect
  FROM trended WHERE part = 'train' AND y IS NOT NULL GROUP BY 1, 2, 3, 4), predicted AS (
  SELECT t.*, e.effect,
         CASE WHEN seasonality_mode = 'additive' THEN trend + coalesce(effect, 0)
              ELSE trend * coalesce(effect, 1) END AS yhat
  FROM trended t LEFT JOIN effects e
    ON e.series = t.series AND e.fold_id = t.fold_id AND e.param_id = t.param_id AND e.m = month(t.ds))"""

ERRORS = """count(*) AS n,
         avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) * 100 AS mape,
         avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse"""

SCORES = f"""scores AS (
  SELECT series, param_id, fold_id, {ERRORS}
  FROM predicted WHERE part = 'val' AND y IS NOT NULL GROUP BY 1, 2, 3)"""


def bounds(source, coverage, around, steps=60):
    """Half width of every step ahead (``widths``: series, step, width) from the validation rows of ``source``."""
    return f"""gaps AS (
  SELECT series, t - start_idx - train_n + 1 AS step, abs(y - yhat) AS gap
  FROM (SELECT * FROM {source}) q WHERE part = 'val' AND y IS NOT NULL AND yhat IS NOT NULL), windows AS (
  SELECT series, max(step) AS last FROM gaps GROUP BY 1), pools AS (
  SELECT w.series, w.last, s.s AS step, list_sort(list(g.gap)) AS pool
  FROM windows w JOIN range(1, {steps + 1}) s(s) ON s.s <= w.last
  JOIN gaps g ON g.series = w.series AND abs(g.step - s.s) <= {around} GROUP BY ALL), grown AS (
  SELECT series, last, step, max(pool[CAST(least(len(pool), ceil((len(pool) + 1) * {coverage})) AS INTEGER)])
           OVER (PARTITION BY series ORDER BY step) AS width
  FROM pools), rates AS (
  SELECT series, last, max(width) AS width, greatest(0, coalesce(regr_slope(width, step), 0)) AS rate
  FROM grown GROUP BY ALL), widths AS (
  SELECT series, step, width FROM grown
  UNION ALL
  SELECT series, s.s, width + rate * (s.s - last) FROM rates JOIN range(1, {steps + 1}) s(s) ON s.s > last)"""


MEANS = """means AS (
  SELECT series, param_id, avg(mape) AS mape, avg(mae) AS mae, count(*) AS n_folds
  FROM scores GROUP BY 1, 2), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(mape, 9) NULLS LAST, param_id) AS rank
  FROM means), best AS (SELECT * FROM ranked WHERE rank = 1)"""


def tuned(panel=PANEL_5, split=None):
    """Everything up to ``best``: closed-form model tuned on ``split``."""
    split = split or holdout(12, final=True)
    return ",\n".join([f"WITH {panel}", spine(PLUS_12), split, TREND_MONTH, SCORES, MEANS])


ROLLING_36 = (36, 12, 12)

# Quadratic detrending and centred calendar-month effects on ``fold_rows``.
DECOMPOSED = """mid AS (
  SELECT series, fold_id, (min(t) + max(t)) / CAST(2 AS DOUBLE) AS centre
  FROM fold_rows WHERE part = 'train' AND y IS NOT NULL GROUP BY 1, 2), centred AS (
  SELECT r.*, r.t - centre AS u FROM fold_rows r JOIN mid USING (series, fold_id)), mom AS (
  SELECT series, fold_id, CAST(count(*) AS DOUBLE) AS a, sum(u) AS b, sum(u*u) AS c, sum(u*u*u) AS e,
         sum(u*u*u*u) AS f, sum(y) AS r1, sum(u*y) AS r2, sum(u*u*y) AS r3
  FROM centred WHERE part = 'train' AND y IS NOT NULL GROUP BY 1, 2), poly AS (
  SELECT series, fold_id,
    (r1*(c*f - e*e) - b*(r2*f - e*r3) + c*(r2*e - c*r3)) / (a*(c*f - e*e) - b*(b*f - c*e) + c*(b*e - c*c)) AS c0,
    (a*(r2*f - e*r3) - r1*(b*f - c*e) + c*(b*r3 - c*r2)) / (a*(c*f - e*e) - b*(b*f - c*e) + c*(b*e - c*c)) AS c1,
    (a*(c*r3 - e*r2) - b*(b*r3 - c*r2) + r1*(b*e - c*c)) / (a*(c*f - e*e) - b*(b*f - c*e) + c*(b*e - c*c)) AS c2
  FROM mom), detrended AS (
  SELECT r.*, c0, c1, c2, c0 + c1*u + c2*u*u AS trend, y - (c0 + c1*u + c2*u*u) AS resid
  FROM centred r JOIN poly USING (series, fold_id)), seas AS (
  SELECT series, fold_id, month(ds) AS m, avg(resid) AS effect
  FROM detrended WHERE part = 'train' AND y IS NOT NULL GROUP BY 1, 2, 3), season AS (
  SELECT series, fold_id, m, effect - avg(effect) OVER (PARTITION BY series, fold_id) AS season FROM seas),
  parts AS (
  SELECT d.*, coalesce(s.season, 0) AS season, resid - coalesce(s.season, 0) AS z
  FROM detrended d LEFT JOIN season s
    ON s.series = d.series AND s.fold_id = d.fold_id AND s.m = month(d.ds))"""

ALL_TRAIN = """fold_rows AS (
  SELECT *, 0 AS fold_id, CASE WHEN t < n THEN 'train' ELSE 'future' END AS part FROM indexed)"""


def solved(source, p, ridge):
    """Coefficients of many regressions by Gauss-Jordan elimination.

    ``source`` has series, fold_id, param_id, x (list of p doubles) and v for
    the training rows; the result ``coefs`` has the list ``coef``.
    """
    diagonal = "[" + ", ".join(repr(float(r)) for r in ridge) + "]"
    return f"""cells AS (
  SELECT series, fold_id, param_id, i.i AS i, j.j AS j,
         sum(x[i.i] * x[j.j]) + CASE WHEN i.i = j.j THEN {diagonal}[i.i] ELSE 0 END AS g
  FROM {source}, range(1, {p + 1}) AS i(i), range(1, {p + 1}) AS j(j)
  GROUP BY series, fold_id, param_id, i.i, j.j
  UNION ALL
  SELECT series, fold_id, param_id, i.i, {p + 1}, sum(x[i.i] * v)
  FROM {source}, range(1, {p + 1}) AS i(i) GROUP BY series, fold_id, param_id, i.i), lines AS (
  SELECT series, fold_id, param_id, i, list(g ORDER BY j) AS line FROM cells
  GROUP BY series, fold_id, param_id, i), eliminated AS (
  SELECT series, fold_id, param_id, CAST(0 AS BIGINT) AS k, list(line ORDER BY i) AS m
  FROM lines GROUP BY series, fold_id, param_id
  UNION ALL
  SELECT series, fold_id, param_id, k + 1,
         list_transform(range(1, {p + 1}), lambda i: CASE WHEN i = k + 1
           THEN list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1])
           ELSE list_transform(range(1, {p + 2}),
                               lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
  FROM eliminated WHERE k < {p}), coefs AS (
  SELECT series, fold_id, param_id, list_transform(m, lambda r: r[{p + 1}]) AS coef
  FROM eliminated WHERE k = {p})"""
