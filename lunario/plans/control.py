"""Parameters of a run, file by file.

A control table has a row per file: ``file`` (name without folders), ``as_of`` (the
forecast ends in December of the third year after it), ``forecast_end``,
``first_column`` and ``last_column`` (of the value columns, from 1) and ``sets``
(numbers of the parameter sets that may be chosen). Any of them may be null or
missing; what a row leaves open comes from the file's name (the year range at its
end), then from the file's last month.
"""

from pyspark.sql import functions as F

from lunario.functions.calendar import default_horizon, month_start
from lunario.session import written
from lunario.sources.names import base_name

CONTROLS = {
    "as_of": "date", "forecast_end": "date", "first_column": "int", "last_column": "int", "sets": "array<int>",
}


def control_rows(controls):
    """One row a file with all columns of a control table, written; of several rows for a file the largest values hold."""
    kinds = [F.col(c).cast(k).alias(c) if c in controls.columns else F.lit(None).cast(k).alias(c) for c, k in CONTROLS.items()]
    rows = controls.where("file is not null").select(F.col("file"), *kinds)
    return written(rows.groupBy("file").agg(*[F.max(c).alias(c) for c in CONTROLS]), "controls")


def controlled(obs, controls=None):
    """Add the control columns of its file, all null without a table, to each row of ``obs`` (file_id, ...)."""
    if controls is None:
        return obs.withColumns({c: F.lit(None).cast(k) for c, k in CONTROLS.items()})
    named = obs.withColumn("file", base_name(F.col("file_id")))
    return named.join(controls, "file", "left").drop("file")


def forecast_until():
    """The last month to forecast as far as the control row or the file's name say; else null."""
    by_name = F.make_date(F.col("horizon_end"), F.lit(12), F.lit(1))
    return F.coalesce(month_start(F.col("forecast_end")), default_horizon(F.col("as_of")), by_name)


def in_range():
    """Whether a value column is one of those asked for."""
    return F.col("col_pos").between(F.coalesce("first_column", F.lit(1)), F.coalesce("last_column", F.lit(2**31 - 1)))


def allowed_sets(records, controls):
    """Records of the parameter sets that their file may take."""
    if controls is None:
        return records
    listed = controls.where("sets is not null").select("file", "sets")
    named = records.withColumn("file", base_name(F.col("file_id"))).join(listed, "file", "left")
    return named.where(F.col("sets").isNull() | F.array_contains("sets", F.col("param_id"))).drop("file", "sets")
