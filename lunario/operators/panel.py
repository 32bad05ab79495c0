"""Panel operators.

A panel has one row per series and month (``ds``), so a series never has more
rows than there are months. Raw rows are brought to that grain by a grouped
aggregate first, which combines on the map side; every per-series window below
therefore works on a short, bounded group however large the raw input is.
All windows share the series partitioning, so one shuffle serves a whole chain.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lunario.fixed import FAR_GROUP, FAR_MONTHS, FILL_GAP, FILL_WINDOW
from lunario.functions.calendar import month_number

FINAL = -1  # fold id of the refit on all history


def melt_panel(wide, ds="ds"):
    """Wide table (month + one column per series) to a long panel."""
    names = [c for c in wide.columns if c != ds]
    return wide.unpivot([ds], names, "series", "y")


def with_span(panel, keys=("series",)):
    """Add first and last month, month count ``n`` and time index ``t`` (from 0).

    The index counts calendar months, so a missing month leaves a hole in it
    instead of shifting what follows.
    """
    whole = Window.partitionBy(*keys)
    first = F.min("ds").over(whole)
    last = F.max("ds").over(whole)
    return panel.select("*", first.alias("first_ds"), last.alias("last_ds")).withColumns(
        {
            "t": month_number(F.col("ds")) - month_number(F.col("first_ds")),
            "n": month_number(F.col("last_ds")) - month_number(F.col("first_ds")) + 1,
        }
    )


time_index = with_span


def extend_months(panel, end=None, keys=("series",)):
    """Indexed panel with missing months filled in and future months added.

    Every row yields the months up to the next observed one, so no calendar
    table and no join are needed. ``end`` is a date column (may use
    ``last_ds``); without it only the gaps are filled. New rows have null
    ``y`` and ``is_gap`` or ``is_future`` set.
    """
    ordered = Window.partitionBy(*keys).orderBy("ds")
    spanned = with_span(panel, keys).withColumn("next_ds", F.lead("ds").over(ordered))
    until = F.col("ds") if end is None else F.greatest(end, F.col("ds"))
    stop = F.coalesce(F.add_months(F.col("next_ds"), -1), until)
    months = F.sequence(F.col("ds"), stop, F.expr("interval 1 month"))
    added = F.col("month") > F.col("ds")
    rest = [c for c in panel.columns if c not in (*keys, "ds", "y")]
    return (
        spanned.withColumn("month", F.explode(months))
        .select(
            *keys,
            *rest,
            F.col("month").alias("ds"),
            F.when(~added, F.col("y")).alias("y"),
            (added & F.col("next_ds").isNotNull()).alias("is_gap"),
            (added & F.col("next_ds").isNull()).alias("is_future"),
            "first_ds",
            "last_ds",
            "n",
            (month_number(F.col("month")) - month_number(F.col("first_ds"))).alias("t"),
        )
    )


def far_months(panel, keys=("series",), gap=FAR_MONTHS, group=FAR_GROUP):
    """Add ``reason``: ``far_month`` for months that a series can hardly have.

    Months with no gap of more than ``gap`` months between them are an island. All
    islands of at most ``group`` months but the largest one (the latest of equal
    ones) are far away, whatever their years; filling the months in between would
    blow the series up. A longer island is a real break and stays.
    """
    ordered = Window.partitionBy(*keys).orderBy("ds")
    since = month_number(F.col("ds")) - F.lag(month_number(F.col("ds"))).over(ordered)
    # gaps are numbered first: a window inside a window's argument needs a column of its own
    numbered = panel.withColumn("after_gap", (since > gap).cast("int"))
    numbered = numbered.withColumn("island", F.coalesce(F.sum("after_gap").over(ordered), F.lit(0)))
    sized = numbered.withColumn("island_months", F.count(F.lit(1)).over(Window.partitionBy(*keys, "island")))
    largest = F.max(F.struct("island_months", "island")).over(Window.partitionBy(*keys))["island"]
    return sized.withColumn("largest", largest).withColumn(
        "reason", F.when((F.col("island") != F.col("largest")) & (F.col("island_months") <= group), "far_month")
    ).drop("after_gap", "island", "island_months", "largest")


def monthly_spine(panel, keys=("series",)):
    """Regular monthly grid per series; gap months have null ``y``."""
    return extend_months(panel, None, keys).drop("is_future")


def carry_forward(rows, keys=("series",)):
    """Add ``y_known``: the latest value observed up to and including the row."""
    past = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("y_known", F.last("y", ignorenulls=True).over(past))


def fill_missing(rows, keys=("series", "fold_id"), gap=FILL_GAP, window=FILL_WINDOW):
    """Fold rows whose missing training values are filled in: adds ``fill`` (observed, linear, mean or null).

    A gap of up to ``gap`` months between two known values is interpolated, each
    neighbour weighing the more the nearer it is. Longer gaps, and months before the
    first or after the last known value, take the mean of the known values within
    ``window`` months, and stay null where there are none. Only training rows are
    filled and only they are looked at.
    """
    known = F.when(F.col("part") == "train", F.col("y"))
    point = F.when(known.isNotNull(), F.struct("t", known.alias("y")))
    ordered = Window.partitionBy(*keys).orderBy("t")
    before = ordered.rowsBetween(Window.unboundedPreceding, 0)
    after = ordered.rowsBetween(0, Window.unboundedFollowing)
    near = ordered.rangeBetween(-window, window)
    around = rows.select(
        "*",
        F.last(point, ignorenulls=True).over(before).alias("last_known"),
        F.first(point, ignorenulls=True).over(after).alias("next_known"),
        F.avg(known).over(near).alias("near_mean"),
    )
    low, high = F.col("last_known"), F.col("next_known")
    share = (F.col("t") - low["t"]) / (high["t"] - low["t"])
    linear = low["y"] + (high["y"] - low["y"]) * share
    missing = (F.col("part") == "train") & F.col("y").isNull()
    between = (high["t"] - low["t"] - 1) <= gap
    how = (
        F.when(F.col("y").isNotNull(), "observed")
        .when(missing & between, "linear")
        .when(missing & F.col("near_mean").isNotNull(), "mean")
    )
    filled = around.withColumn("fill", how)
    value = F.when(F.col("fill") == "linear", linear).when(F.col("fill") == "mean", F.col("near_mean")).otherwise(F.col("y"))
    return filled.withColumn("y", value).drop("last_known", "next_known", "near_mean")


def ar_lags(rows, lags, y="y", keys=("series",), order="t"):
    """Add ``lag_1..lag_L`` of ``y`` in time order."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({f"lag_{k}": F.lag(y, k).over(ordered) for k in range(1, lags + 1)})


def holdout_split(indexed, val, context=0):
    """Mark the last ``val`` months as validation, ``context`` months before as lead-in."""
    start = F.col("n") - val
    return indexed.withColumn("part", F.when(F.col("t") >= start, "val").otherwise("train")).withColumn(
        "is_context", (F.col("t") < start) & (F.col("t") >= start - context)
    )


def _fold(fold_id, start, train_n, val_n):
    return F.struct(
        F.lit(fold_id).cast("int").alias("fold_id") if isinstance(fold_id, int) else fold_id.cast("int").alias("fold_id"),
        start.cast("int").alias("start_idx"),
        train_n.cast("int").alias("train_n"),
        val_n.cast("int").alias("val_n"),
    )


def holdout_folds(val):
    """Split scheme: fold 0 trains on all but the last ``val`` months."""

    def folds(t, n):
        one = F.array(_fold(0, F.lit(0), n - val, F.lit(val)))
        return F.when((n > val) & (t < n), one)

    return folds


def rolling_folds(train, val, step):
    """Split scheme: windows of ``train + val`` months moved on by ``step`` months.

    The folds of a row follow from its index by arithmetic, so rows are
    exploded rather than range-joined.
    """

    def folds(t, n):
        size = train + val
        low = F.greatest(F.lit(0), F.ceil((t - size + 1) / F.lit(step)).cast("int"))
        high = F.least(F.floor(t / F.lit(step)), F.floor((n - size) / F.lit(step))).cast("int")
        ids = F.sequence(low, high)
        return F.when(
            (n >= size) & (t < n) & (low <= high),
            F.transform(ids, lambda f: _fold(f, f * step, F.lit(train), F.lit(val))),
        )

    return folds


def assign_folds(indexed, scheme, final=False):
    """One row per (row, fold): adds fold columns and ``part`` (train, val or future).

    With ``final`` every row also joins fold ``FINAL``, which trains on all
    history and covers the future months.
    """
    t, n = F.col("t"), F.col("n")
    none = F.array().cast("array<struct<fold_id:int,start_idx:int,train_n:int,val_n:int>>")
    folds = F.coalesce(scheme(t, n), none)
    if final:
        folds = F.concat(folds, F.array(_fold(FINAL, F.lit(0), n, F.lit(0))))
    train_end = F.col("start_idx") + F.col("train_n")
    return (
        indexed.withColumn("fold", F.explode(folds))
        .select("*", "fold.*")
        .drop("fold")
        .withColumn(
            "part",
            F.when(t < train_end, "train").when(t < train_end + F.col("val_n"), "val").otherwise("future"),
        )
    )


def union_history(history, forecasts):
    """History and forecast rows in one frame, told apart by ``kind``."""
    return history.withColumn("kind", F.lit("history")).unionByName(
        forecasts.withColumn("kind", F.lit("forecast")), allowMissingColumns=True
    )


def series_profile(panel, keys=("series",)):
    """Months with rows, months with a value, first year and last month per series."""
    return panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"),
        F.count("y").alias("observed"),
        F.min(F.year("ds")).alias("first_year"),
        F.max("ds").alias("last_ds"),
    )
