"""Fold records: one row per fit, and the choice of the best parameter set.

A record holds the keys, ``param_id``, ``fold_id``, the fold's errors and its
predictions as an array (bounded by the validation window or the horizon).
Records of a series stay in its partition, so tuning, choosing and forecasting
need no further shuffle and no second fit.
"""

from pyspark.sql import functions as F

from lunario.operators.panel import FINAL
from lunario.operators.scoring import abs_error, finite, percent_error, score_order

PREDICTIONS = "array<struct<ds:date,y:double,yhat:double>>"


def _mean(values):
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def with_errors(records):
    """Add n, mape, mae and mse from the ``predictions`` array."""
    known = F.filter(
        F.col("predictions"), lambda p: p["y"].isNotNull() & finite(p["yhat"]).isNotNull()
    )
    scored = records.withColumn("known", known)
    k = F.col("known")
    return scored.withColumns(
        {
            "n": F.size(k),
            "mape": _mean(F.transform(k, lambda p: percent_error(p["y"], p["yhat"]))) * 100,
            "mae": _mean(F.transform(k, lambda p: abs_error(p["y"], p["yhat"]))),
            "mse": _mean(F.transform(k, lambda p: F.pow(p["y"] - p["yhat"], 2))),
        }
    ).drop("known")


def records_from_rows(predicted, keys=("series",)):
    """Records from one row per predicted month (parts val and future)."""
    points = F.struct("ds", "y", "yhat")
    return with_errors(
        predicted.where("part <> 'train'")
        .groupBy(*keys, "param_id", "fold_id")
        .agg(F.sort_array(F.collect_list(points)).cast(PREDICTIONS).alias("predictions"))
    )


def by_series(records, keys=("series",)):
    """Records brought together by series after the Python solve.

    The solve hides the partitioning, so without this each later grouping
    would shuffle on its own; records are small by now.
    """
    fields = ["param_id", "fold_id", "n", "mape", "mae", "mse", "predictions"]
    return records.select(*keys, *fields).repartition(*keys)


def scores(records):
    """Fold scores without the predictions; the final fit has none."""
    return records.where(F.col("fold_id") != FINAL).drop("predictions")


def choose(records, keys=("series",)):
    """Best parameter set per series with its validation and final predictions.

    Lowest mean MAPE wins, ties and unscored series fall to the first set.
    ``status`` is ``no_folds`` when no fold could be fitted: the history is too
    short for any, or none has a value to train on.
    """
    validating = F.col("fold_id") != FINAL
    # a fold's predictions are consecutive months, so their place tells the steps ahead
    tagged = F.transform(
        F.col("predictions"),
        lambda p, i: F.struct(
            F.col("fold_id"), (i + 1).alias("step"), p["ds"].alias("ds"), p["y"].alias("y"), p["yhat"].alias("yhat")
        ),
    )
    fitted = validating & F.exists("predictions", lambda p: p["yhat"].isNotNull())
    per_set = records.groupBy(*keys, "param_id").agg(
        F.avg(F.when(validating, finite(F.col("mape")))).alias("mape"),
        F.avg(F.when(validating, finite(F.col("mae")))).alias("mae"),
        F.count(F.when(fitted, 1)).alias("n_folds"),
        F.flatten(F.collect_list(F.when(validating, tagged))).alias("validation"),
        F.first(F.when(~validating, F.col("predictions")), ignorenulls=True).alias("forecast"),
    )
    order = F.struct(score_order(F.col("mape")), F.col("param_id"))
    fields = ["param_id", "mape", "mae", "n_folds", "validation", "forecast"]
    return (
        per_set.groupBy(*keys)
        .agg(F.min_by(F.struct(*fields), order).alias("best"))
        .select(*keys, "best.*")
        .withColumn("status", F.when(F.col("n_folds") > 0, "tuned").otherwise("no_folds"))
    )


def forecast_rows(chosen, keys=("series",)):
    """One row per series and future month."""
    return chosen.select(*keys, "param_id", "mape", "status", F.inline("forecast")).drop("y")


def validation_rows(chosen, keys=("series",)):
    """The winner's own validation predictions; nothing is refitted."""
    return chosen.select(*keys, "param_id", F.inline("validation")).drop("step")
