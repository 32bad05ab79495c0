"""Month arithmetic as column expressions."""

from pyspark.sql import functions as F


def month_start(ts):
    return F.trunc(ts, "MM")


def month_number(ds):
    """Months since year 0, so that differences count months."""
    return F.year(ds) * 12 + F.month(ds) - 1


def month_label(ds):
    return F.date_format(ds, "yyyy-MM")


def next_month(ds):
    return F.add_months(ds, 1)


def horizon_months(last, end):
    """Months to forecast after ``last`` up to and including ``end``."""
    return month_number(end) - month_number(last)


def default_horizon(as_of):
    """December of the third year after ``as_of``."""
    return F.make_date(F.year(as_of) + 3, F.lit(12), F.lit(1))


def future_months(last, end):
    """Month starts after ``last`` up to ``end``; empty when there are none."""
    return F.when(
        end > last, F.sequence(F.add_months(last, 1), end, F.expr("interval 1 month"))
    ).otherwise(F.array().cast("array<date>"))


def future_frame(last_df, end, ds="last_ds"):
    """One row per future month for every row of ``last_df``."""
    return last_df.withColumn("ds", F.explode(future_months(F.col(ds), end)))


def calendar_features(df, ds="ds"):
    return df.withColumns({"month": F.month(ds), "quarter": F.quarter(ds), "year": F.year(ds)})
