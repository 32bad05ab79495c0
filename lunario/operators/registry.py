"""Metric groups and the models available for them."""

from pyspark.sql import functions as F

from lunario.fixed import AVAILABLE_MODELS, METRIC_GROUPS
from lunario.functions.text import strip
from lunario.session import values_frame

MODEL_KEYS = ["metric_group", "scope", "model"]


def metric_groups(spark):
    return values_frame(spark, ["metric_key", "metric_group"], list(METRIC_GROUPS.items()))


def available(spark):
    return values_frame(spark, MODEL_KEYS, AVAILABLE_MODELS)


def with_metric_group(df):
    """Add ``metric_group``; null where the metric is unknown.

    The lookup table is a handful of fixed rows, so it is broadcast.
    """
    groups = F.broadcast(metric_groups(df.sparkSession))
    key = F.lower(strip(F.col("metric")))
    return df.join(groups, key == F.col("metric_key"), "left").drop("metric_key")


def available_models(df):
    """Rows whose (group, scope, model) can be run."""
    return df.join(F.broadcast(available(df.sparkSession)), MODEL_KEYS)


def unavailable_models(df):
    """Rows whose (group, scope, model) cannot be run."""
    return df.join(F.broadcast(available(df.sparkSession)), MODEL_KEYS, "left_anti")


def with_models(df):
    """Each row once per model available for its group and scope."""
    return df.join(F.broadcast(available(df.sparkSession)), ["metric_group", "scope"])
