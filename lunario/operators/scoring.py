"""Errors of predictions, and choosing parameter sets by them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lunario.fixed import EPSILON

FIT_KEYS = ["series", "param_id", "fold_id"]


def abs_error(y, yhat):
    return F.abs(y - yhat)


def percent_error(y, yhat):
    return abs_error(y, yhat) / F.greatest(F.abs(y), F.lit(EPSILON))


def mape(y="y", yhat="yhat"):
    return F.avg(percent_error(F.col(y), F.col(yhat))) * 100


def mae(y="y", yhat="yhat"):
    return F.avg(abs_error(F.col(y), F.col(yhat)))


def mse(y="y", yhat="yhat"):
    return F.avg(F.pow(F.col(y) - F.col(yhat), 2))


def finite(x):
    """Null instead of NaN or infinity, so that averages and orders ignore it."""
    return F.when(F.abs(x) < float("inf"), x)


def score(predictions, keys=FIT_KEYS):
    """MAPE, MAE and MSE per key over rows whose actual value is known."""
    return (
        predictions.where(F.col("y").isNotNull() & finite(F.col("yhat")).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            mape().alias("mape"),
            mae().alias("mae"),
            mse().alias("mse"),
        )
    )


def score_join(actual, predicted, keys=("series", "fold_id", "param_id")):
    """Pair actual values with predictions by series, fold, parameters and month."""
    on = [k for k in keys if k in actual.columns and k in predicted.columns]
    return actual.join(predicted, [*on, "ds"])


def score_order(score):
    """Order of a score: unscored last, differences below 1e-9 count as ties.

    Without the rounding, sets with equal predictions would be ranked by
    floating-point noise.
    """
    return F.coalesce(F.round(finite(score), 9), F.lit(float("inf")))


def fold_mean(scores, keys=("series",)):
    """Unweighted mean over folds for each parameter set."""
    return scores.groupBy(*keys, "param_id").agg(
        F.avg(finite(F.col("mape"))).alias("mape"),
        F.avg(finite(F.col("mae"))).alias("mae"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def best_params(means, keys=("series",)):
    """Parameter set with the lowest MAPE per series; the first one wins ties.

    A set without a score loses to any scored one and is only chosen when no
    set of that series has a score.
    """
    order = F.struct(score_order(F.col("mape")), F.col("param_id"))
    rest = [c for c in means.columns if c not in keys]
    return (
        means.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("best"))
        .select(*keys, "best.*")
    )


def rank_params(means, keys=("series",)):
    """Rank of each parameter set, unscored sets last, ties in parameter order."""
    order = Window.partitionBy(*keys).orderBy(score_order(F.col("mape")), "param_id")
    return means.withColumn("rank", F.row_number().over(order))


def macro_mean(scores, keys=()):
    """Unweighted mean of per-series errors; series without a score are skipped."""
    return scores.groupBy(*keys).agg(
        F.avg(finite(F.col("mape"))).alias("mape"),
        F.avg(finite(F.col("mae"))).alias("mae"),
        F.count(finite(F.col("mape"))).alias("n_series"),
    )


def ensemble_mean(forecasts, keys=("series",)):
    """Average of the models' forecasts, and bounds if they have any, for months that two or more models cover."""
    averaged = [F.avg(c).alias(c) for c in ("yhat", "lower", "upper") if c in forecasts.columns]
    return (
        forecasts.groupBy(*keys, "ds")
        .agg(*averaged, F.count_distinct("model").alias("n_models"))
        .where("n_models >= 2")
    )


def stack_models(*frames):
    """Forecasts or scores of several models in one frame."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked
