"""Bounds of forecasts from the errors of the chosen set's folds.

Errors grow with the number of steps ahead, but a step has only as many errors as
there are folds. The half width of a step is therefore the conformal quantile of
the absolute errors at that step and the few steps around it: of n errors the one
of rank ceil((n + 1) * coverage), the largest where that exceeds n. Widths never
shrink from one step to the next. Steps beyond the validation window go on from its
last width by the rate at which the widths grow within it, fitted by least squares
and never negative.

Everything is an expression over the arrays of a series' row (its validation months
and its forecast months), so bounds cost no shuffle.
"""

from pyspark.sql import functions as F

from lunario.functions.columns import computed_once
from lunario.operators.scoring import finite

COVERAGE = 0.8
AROUND = 3


def _pools(around):
    """For steps 1 to the last one with an error, the sorted errors around each."""
    last = F.array_max(F.col("errors")["step"])

    def pool(step):
        near = F.filter("errors", lambda e: F.abs(e["step"] - step) <= around)
        return F.array_sort(near["gap"])

    return F.when(last.isNotNull(), F.transform(F.sequence(F.lit(1), last), pool))


def _widths(coverage):
    def quantile(pool):
        rank = F.least(F.size(pool), F.ceil((F.size(pool) + 1) * coverage)).cast("int")
        return F.get(pool, rank - 1)

    def grow(widths, width):
        return F.concat(widths, F.array(F.greatest(width, F.try_element_at(widths, F.lit(-1)))))

    # a step whose neighbourhood has no known value takes all errors of the series
    every = F.array_sort(F.col("errors")["gap"])
    quantiles = F.transform("pools", lambda p: F.when(F.size(p) > 0, quantile(p)).otherwise(quantile(every)))
    return F.when(F.col("pools").isNotNull(), F.aggregate(quantiles, F.array().cast("array<double>"), grow))


def growth_rate(widths):
    """Least-squares slope of the widths over their steps, at least 0."""
    n = F.size(widths)
    centred = F.transform(widths, lambda w, i: w * (i - (n - 1) / 2))
    total = F.aggregate(centred, F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.when(n > 1, total * 12 / (n * (n * n - 1.0))).otherwise(F.lit(0.0)))


def with_bounds(chosen, coverage=COVERAGE, around=AROUND):
    """``chosen`` rows whose forecast months also have ``lower`` and ``upper``; null where no fold has an error."""
    gaps = F.transform(
        "validation", lambda v: F.struct(v["step"].alias("step"), finite(F.abs(v["y"] - v["yhat"])).alias("gap"))
    )
    # each stage refers to the one before more than once
    measured = computed_once(chosen, {"errors": F.filter(gaps, lambda e: e["gap"].isNotNull())})
    measured = computed_once(measured, {"pools": _pools(around)})
    measured = computed_once(measured, {"widths": _widths(coverage)})
    measured = computed_once(measured, {"rate": growth_rate(F.col("widths"))})
    n = F.size("widths")

    def bounded(point, i):
        beyond = F.element_at("widths", -1) + F.col("rate") * (i + 1 - n)
        width = F.when(i < n, F.get("widths", i)).otherwise(beyond)
        return F.struct(
            point["ds"].alias("ds"), point["y"].alias("y"), point["yhat"].alias("yhat"),
            (point["yhat"] - width).alias("lower"), (point["yhat"] + width).alias("upper"),
        )

    return measured.withColumn("forecast", F.transform("forecast", bounded)).drop("errors", "pools", "widths", "rate")
