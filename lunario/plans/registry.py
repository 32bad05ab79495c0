"""Named queries and the SQL each is checked against."""

from pyspark.sql import functions as F
from pyspark.sql.types import DateType

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its check SQL."""

    def add(fn):
        QUERIES[name] = lambda spark, sf: month_labels(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def month_labels(df):
    """Month columns as ``YYYY-MM`` text, the form results are published in."""
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, DateType)]
    return df.withColumns({d: F.date_format(d, "yyyy-MM") for d in dates}) if dates else df


def rounded(df, *columns, places=4):
    return df.withColumns({c: F.round(c, places) for c in columns})
