"""Piecewise-linear trend, yearly season and optional autoregression.

growth ``linear`` bends the slope at each changepoint, ``discontinuous`` also
lets the level jump. Changepoints are equidistant in the first 80 % of the
training window. The yearly season has Fourier order 6; on monthly data its
sixth sine is zero everywhere and is left out. In multiplicative mode the
season is the mean ratio to the trend by calendar month, fitted after it.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lunario.fixed import TREND_SEASON_GRID
from lunario.operators.grid import with_params
from lunario.operators.models.least_squares import dot, fit
from lunario.operators.models.records import PREDICTIONS, by_series, with_errors
from lunario.operators.panel import ar_lags, carry_forward

FOURIER_ORDER = 6
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_RIDGE = 1e-6


def trend_terms(grid):
    """Trend columns shared by all parameter sets; unused ones are zero."""
    most = max(grid["n_changepoints"])
    knots = [f"({CHANGEPOINT_RANGE * j} / (n_changepoints + 1))" for j in range(1, most + 1)]
    terms = ["1D", "s"]
    terms += [
        f"if(n_changepoints >= {j}, greatest(s - {knot}, 0D), 0D)" for j, knot in enumerate(knots, start=1)
    ]
    if "discontinuous" in grid["growth"]:
        terms += [
            f"if(growth = 'discontinuous' AND n_changepoints >= {j} AND s >= {knot}, 1D, 0D)"
            for j, knot in enumerate(knots, start=1)
        ]
    return terms, [0.0, 0.0] + [CHANGEPOINT_RIDGE] * (len(terms) - 2)


def season_terms():
    angle = 2.0 * math.pi / 12.0
    cosines = [f"cos({angle * k}D * month)" for k in range(1, FOURIER_ORDER + 1)]
    return cosines + [f"sin({angle * k}D * month)" for k in range(1, FOURIER_ORDER)]


def fit_trend_season(rows, grid=TREND_SEASON_GRID, lags=0, keys=("series",)):
    """Fit every (series, fold, parameter set) and predict its later months.

    ``rows`` are fold rows on a regular monthly grid. Values are divided by
    the mean training level of their fold, which keeps lags and time columns
    on one scale. Returns one row per fit with ``coef`` and ``steps`` (the
    validation or future months in order).
    """
    by = [*keys, "fold_id"]
    known = carry_forward(rows, by)
    if lags:
        known = ar_lags(known, lags, "y_known", by)
    lag_names = [f"lag_{k}" for k in range(1, lags + 1)]
    train = "part = 'train' AND y IS NOT NULL"
    scale = F.avg(F.expr(f"if({train}, abs(y), NULL)")).over(Window.partitionBy(*by))
    scaled = known.withColumn("scale", F.when(scale > 0, scale).otherwise(1.0)).select(
        *by, "part", "t", "ds", "y", "scale", "start_idx", "train_n",
        F.month("ds").alias("month"),
        # 0 at the first, 1 at the last training month; beyond 1 afterwards
        F.expr("(t - start_idx) / greatest(train_n - 1, 1)").alias("s"),
        F.expr("y / scale").alias("target"),
        F.expr("y_known / scale").alias("v_known"),
        F.expr(" AND ".join([train, *[f"{n} IS NOT NULL" for n in lag_names]])).alias("usable"),
        *[(F.col(n) / F.col("scale")).alias(n) for n in lag_names],
    )
    trend, ridge = trend_terms(grid)
    season = season_terms()
    # time terms become columns first, so the aggregate refers to plain doubles
    count = len(trend) + len(season)
    time_names = [f"d{i}" for i in range(count)]
    designed = with_params(scaled, grid).selectExpr(
        "*", *[f"{term} AS {name}" for name, term in zip(time_names, trend + season)]
    )
    later = F.col("part") != "train"
    time_array = F.array(*time_names)
    gather = [
        F.sort_array(
            F.collect_list(
                F.when(later, F.struct("t", "ds", "y", "month", time_array.alias("x")))
            )
        ).alias("steps"),
        F.first("scale").alias("scale"),
        F.first("seasonality_mode").alias("mode"),
    ]
    if lags:
        recent = F.col("t") >= F.col("start_idx") + F.col("train_n") - lags
        seed = F.when(
            (F.col("part") == "train") & recent,
            F.struct("t", F.col("v_known").alias("v")),
        )
        gather.append(F.sort_array(F.collect_list(seed), asc=False).alias("seed"))
    fitted = fit(
        designed,
        [*keys, "fold_id", "param_id"],
        [*time_names, *lag_names],
        "target",
        "usable",
        ridge + [0.0] * (len(season) + lags),
        gather,
    )
    fitted = fitted.withColumns(
        {
            "trend_coef": F.slice("coef", 1, len(trend)),
            "time_coef": F.slice("coef", 1, count),
            "lag_coef": F.slice("coef", count + 1, lags) if lags else F.array().cast("array<double>"),
        }
    )
    if "multiplicative" in grid["seasonality_mode"]:
        fitted = fitted.withColumn("ratio", F.when(F.col("mode") == "multiplicative", month_ratios(count, lags)))
    return fitted.drop("train")


def month_ratios(count, lags):
    """Mean of (value less its autoregressive part) over trend, by calendar month.

    One pass over the training rows with twelve running sums; a month without
    rows has ratio one.
    """

    def ratio(r):
        rest = r["v"] - dot(F.slice(r["x"], count + 1, lags), F.col("lag_coef")) if lags else r["v"]
        width = F.size("trend_coef")
        return F.try_divide(rest, dot(F.slice(r["x"], F.lit(1), width), F.col("trend_coef")))

    rows = F.transform("train", lambda r: F.struct(r["month"].alias("m"), ratio(r).alias("q")))
    empty = F.array_repeat(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), 12)

    def add(sums, r):
        return F.transform(
            sums,
            lambda a, i: F.when(
                (i + 1 == r["m"]) & r["q"].isNotNull(),
                F.struct((a["s"] + r["q"]).alias("s"), (a["n"] + 1).alias("n")),
            ).otherwise(a),
        )

    def finish(sums):
        return F.transform(sums, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(1.0))

    return F.aggregate(rows, empty, add, finish)


def recursive_values(base, seed, lag_coef):
    """Predict step by step: each value feeds the lags of the next.

    ``base`` is the array of what is known in advance per step, ``seed`` the
    latest values (newest first). Returns the predicted values in order.
    """
    depth = F.size(lag_coef)
    grown = F.aggregate(
        base,
        seed.cast("array<double>"),
        lambda values, b: F.concat(F.array(b + dot(F.slice(values, F.lit(1), depth), lag_coef)), values),
    )
    return F.reverse(F.slice(grown, F.lit(1), F.size(base)))


def predict(fitted, grid, lags):
    """Fold records from fitted rows."""
    steps = F.col("steps")
    values = F.transform(steps, lambda r: dot(r["x"], F.col("time_coef")))
    if "multiplicative" in grid["seasonality_mode"]:
        width = F.size("trend_coef")
        trend = F.transform(steps, lambda r: dot(F.slice(r["x"], F.lit(1), width), F.col("trend_coef")))
        # steps are consecutive months, so their ratios are a run of the yearly cycle
        first, count = F.get(steps, F.lit(0))["month"], F.size(steps)
        cycle = F.flatten(F.array_repeat(F.col("ratio"), F.ceil(count / 12).cast("int") + 1))
        scaled = F.zip_with(trend, F.slice(cycle, first, count), lambda g, q: g * q)
        values = F.when(F.col("mode") == "multiplicative", scaled).otherwise(values)
    based = fitted.withColumn("base", values)
    if lags:
        seed = F.transform("seed", lambda s: s["v"])
        based = based.withColumn("values", recursive_values(F.col("base"), seed, F.col("lag_coef")))
    else:
        based = based.withColumn("values", F.col("base"))
    points = F.zip_with(
        steps,
        "values",
        lambda r, v: F.struct(r["ds"].alias("ds"), r["y"].alias("y"), (v * F.col("scale")).alias("yhat")),
    )
    return with_errors(based.withColumn("predictions", points.cast(PREDICTIONS)))


def trend_season(rows, grid=TREND_SEASON_GRID, lags=0, keys=("series",)):
    """Fold records of the trend + season (+ autoregression) model."""
    return by_series(predict(fit_trend_season(rows, grid, lags, keys), grid, lags), keys)
