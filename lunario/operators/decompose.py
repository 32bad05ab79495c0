"""Quadratic detrending and calendar-month deseasoning, fitted on training rows.

Everything is a window over one series and fold, evaluated for all its rows,
so future months get their trend and season without a join.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F


def solve_symmetric_3(a, b, c, d, e, f, r1, r2, r3):
    """Solve [[a,b,c],[b,d,e],[c,e,f]] x = (r1,r2,r3) by Cramer's rule."""
    det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    x1 = r1 * (d * f - e * e) - b * (r2 * f - e * r3) + c * (r2 * e - d * r3)
    x2 = a * (r2 * f - e * r3) - r1 * (b * f - c * e) + c * (b * r3 - c * r2)
    x3 = a * (d * r3 - e * r2) - b * (b * r3 - c * r2) + r1 * (b * e - c * d)
    ok = F.when(F.abs(det) > 0, det)
    return x1 / ok, x2 / ok, x3 / ok


def train_rows():
    return (F.col("part") == "train") & F.col("y").isNotNull()


def detrend_quadratic(rows, keys=("series",), train=None):
    """Add ``c0, c1, c2``, ``trend`` and ``resid`` from a degree-2 fit on time.

    The index is centred on the middle of the training rows before squaring.
    """
    train = F.col("y").isNotNull() if train is None else train
    whole = Window.partitionBy(*keys)
    t = F.when(train, F.col("t"))
    centred = rows.withColumn("u", F.col("t") - (F.min(t).over(whole) + F.max(t).over(whole)) / 2.0)
    u, y = F.when(train, F.col("u")), F.when(train, F.col("y"))
    moments = {
        "m0": F.count(u), "m1": F.sum(u), "m2": F.sum(u**2), "m3": F.sum(u**3), "m4": F.sum(u**4),
        "q0": F.sum(y), "q1": F.sum(u * y), "q2": F.sum(u**2 * y),
    }
    summed = centred.select("*", *[m.over(whole).alias(k) for k, m in moments.items()])
    m0, m1, m2, m3, m4, q0, q1, q2 = (F.col(k) for k in moments)
    c0, c1, c2 = solve_symmetric_3(m0, m1, m2, m2, m3, m4, q0, q1, q2)
    return (
        summed.select(*centred.columns, c0.alias("c0"), c1.alias("c1"), c2.alias("c2"))
        .withColumn("trend", F.expr("c0 + c1 * u + c2 * u * u"))
        .withColumn("resid", F.col("y") - F.col("trend"))
    )


def deseasonalize(rows, keys=("series",), train=None):
    """Add ``season`` (calendar-month mean of ``resid``, centred) and ``z = resid - season``.

    The twelve effects are centred by their unweighted mean; months without
    training rows have effect zero.
    """
    train = F.col("y").isNotNull() if train is None else train
    whole = Window.partitionBy(*keys)
    month = Window.partitionBy(*keys, F.month("ds"))
    used = F.when(train, F.col("resid"))
    effect = rows.select("*", F.avg(used).over(month).alias("effect"), F.count(used).over(month).alias("month_n"))
    # weighting each row by 1 / rows of its month gives every month the weight 1
    weight = F.when(train, 1.0 / F.col("month_n"))
    centre = F.sum(F.col("effect") * weight).over(whole) / F.sum(weight).over(whole)
    return (
        effect.withColumn("season", F.coalesce(F.col("effect") - centre, F.lit(0.0)))
        .drop("effect", "month_n")
        .withColumn("z", F.col("resid") - F.col("season"))
    )


def revert_transforms(rows, z="z"):
    """Level values from transformed ones: season first, then trend."""
    return rows.withColumn("yhat", F.col(z) + F.col("season") + F.col("trend"))
