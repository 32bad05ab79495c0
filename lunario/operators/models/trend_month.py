"""Closed-form model: linear or flat trend with additive or multiplicative month effects."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lunario.fixed import TREND_MONTH_GRID
from lunario.operators.decompose import train_rows
from lunario.operators.grid import with_params
from lunario.operators.models.records import records_from_rows


def fit_trend_month(rows, grid=TREND_MONTH_GRID, keys=("series",)):
    """Predict every row of every fold: adds ``param_id``, ``trend``, ``effect``, ``yhat``.

    ``rows`` are fold rows (see ``assign_folds``) with validation and future
    months present; only training rows enter the fit.
    """
    train = train_rows()
    fit = Window.partitionBy(*keys, "fold_id")
    y, t = F.when(train, F.col("y")), F.when(train, F.col("t").cast("double"))
    sums = rows.select(
        "*",
        F.regr_slope(y, t).over(fit).alias("slope"),
        F.regr_intercept(y, t).over(fit).alias("intercept"),
        F.avg(y).over(fit).alias("level"),
    )
    linear = F.col("intercept") + F.col("slope") * F.col("t")
    trended = with_params(sums, grid).withColumn(
        "trend", F.when(F.col("growth") == "linear", linear).otherwise(F.col("level"))
    )
    additive = F.col("seasonality_mode") == "additive"
    deviation = F.when(additive, F.col("y") - F.col("trend")).otherwise(F.try_divide("y", "trend"))
    month = Window.partitionBy(*keys, "fold_id", "param_id", F.month("ds"))
    effect = F.avg(F.when(train, deviation)).over(month)
    return trended.withColumn("effect", effect).withColumn(
        "yhat",
        F.when(additive, F.col("trend") + F.coalesce("effect", F.lit(0.0))).otherwise(
            F.col("trend") * F.coalesce("effect", F.lit(1.0))
        ),
    )


def trend_month(rows, grid=TREND_MONTH_GRID, keys=("series",)):
    """Fold records of the closed-form model."""
    return records_from_rows(fit_trend_month(rows, grid, keys), keys)
