"""Autoregressions: the closed-form AR(2) and the decomposed sequence model."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lunario.fixed import DECOMPOSED_GRID
from lunario.operators.decompose import deseasonalize, detrend_quadratic, solve_symmetric_3, train_rows
from lunario.operators.grid import with_params
from lunario.operators.models.least_squares import fit
from lunario.operators.models.records import PREDICTIONS, by_series, with_errors
from lunario.operators.models.trend_season import recursive_values
from lunario.operators.panel import ar_lags


def ar2_fit(lagged, y="y", keys=("series",)):
    """Intercept and two lag coefficients per series, from moment sums."""
    v, a, b = F.col(y), F.col("lag_1"), F.col("lag_2")
    usable = v.isNotNull() & a.isNotNull() & b.isNotNull()
    sums = {
        "n": F.count(F.lit(1)), "sa": F.sum(a), "sb": F.sum(b), "saa": F.sum(a * a), "sab": F.sum(a * b),
        "sbb": F.sum(b * b), "sy": F.sum(v), "say": F.sum(a * v), "sby": F.sum(b * v),
    }
    moments = lagged.where(usable).groupBy(*keys).agg(*[s.alias(k) for k, s in sums.items()])
    n, sa, sb, saa, sab, sbb, sy, say, sby = (F.col(k) for k in sums)
    const, phi1, phi2 = solve_symmetric_3(n, sa, sb, saa, sab, sbb, sy, say, sby)
    return moments.select(*keys, const.alias("const"), phi1.alias("phi_1"), phi2.alias("phi_2"))


def recursive_forecast(coefs, horizon):
    """Values of the next ``horizon`` months from AR(2) coefficients and ``seed`` (newest first)."""
    base = F.array_repeat(F.col("const"), horizon)
    lag_coef = F.array("phi_1", "phi_2")
    return coefs.withColumn("values", recursive_values(base, F.col("seed"), lag_coef))


def decomposed_ar(rows, grid=DECOMPOSED_GRID, keys=("series",)):
    """Fold records: detrend, deseason, autoregress on ``lags`` values, revert.

    Trend, season and autoregression are fitted on the training rows of each
    fold. A month without a value has residual zero when it serves as a lag.
    """
    by = [*keys, "fold_id"]
    train = train_rows()
    parts = deseasonalize(detrend_quadratic(rows, by, train), by, train)
    scale = F.avg(F.when(train, F.abs("z"))).over(Window.partitionBy(*by))
    scaled = parts.withColumn("scale", F.when(scale > 0, scale).otherwise(1.0)).withColumn(
        "target", F.col("z") / F.col("scale")
    )
    most = max(grid["lags"])
    lagged = ar_lags(scaled.withColumn("z_known", F.coalesce("target", F.lit(0.0))), most, "z_known", by)
    usable = train & (F.col("t") >= F.col("start_idx") + F.col("lags"))
    designed = with_params(lagged, grid).withColumn("usable", usable)
    terms = ["1D"] + [f"if(lags >= {k}, lag_{k}, 0D)" for k in range(1, most + 1)]
    later = F.col("part") != "train"
    level = (F.col("trend") + F.col("season")).alias("level")
    recent = F.col("t") >= F.col("start_idx") + F.col("train_n") - most
    gather = [
        F.sort_array(F.collect_list(F.when(later, F.struct("t", "ds", "y", level)))).alias("steps"),
        F.sort_array(
            F.collect_list(
                F.when((F.col("part") == "train") & recent, F.struct("t", F.col("z_known").alias("v")))
            ),
            asc=False,
        ).alias("seed"),
        F.first("scale").alias("scale"),
    ]
    fitted = fit(
        designed, [*keys, "fold_id", "param_id"], terms, "target", "usable", [0.0] * len(terms), gather
    )
    base = F.transform("steps", lambda r: F.get(F.col("coef"), F.lit(0)))
    # short windows: lags a parameter set does not use may lie before the first row
    seed = F.concat(F.transform("seed", lambda s: s["v"]), F.array_repeat(F.lit(0.0), most))
    valued = fitted.withColumn("values", recursive_values(base, seed, F.slice("coef", 2, most)))
    points = F.zip_with(
        "steps",
        "values",
        lambda r, v: F.struct(
            r["ds"].alias("ds"), r["y"].alias("y"), (v * F.col("scale") + r["level"]).alias("yhat")
        ),
    )
    return by_series(with_errors(valued.withColumn("predictions", points.cast(PREDICTIONS))), keys)
