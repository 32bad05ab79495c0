"""Writers for cleaned observations, results and forecasts."""

from pyspark.sql import functions as F

from lunario.functions.text import clean_number_text, is_missing


def clean_text(obs):
    """Cleaned cells: day-one date text and plain decimal text.

    Unreadable dates and missing markers keep their text.
    """
    date = F.coalesce(F.date_format("ds", "dd/MM/yyyy"), F.col("fecha_raw"))
    value = F.when(is_missing(F.col("raw")), F.col("raw")).otherwise(clean_number_text(F.col("raw")))
    return obs.withColumns({"Fecha": date, "valor": value})


def gathered(frame, *keys):
    """Rows of a key together for writing: few files per folder, hot keys split by AQE."""
    return frame.hint("rebalance", *keys)


def _write(frame, path):
    options = {"sep": ";", "header": True, "emptyValue": ""}
    gathered(frame, "file_id").write.partitionBy("file_id").options(**options).csv(path)


def write_clean(obs, path):
    """Write cleaned cells as ``;`` delimited UTF-8 text, one folder per file, one line per cell."""
    _write(clean_text(obs).select("file_id", "Fecha", "series", "valor"), path)


def write_clean_wide(obs, names, path):
    """The same in the shape of the input: one column per series in ``names``.

    The result can be scanned again by ``read_series_files``.
    """
    cells = clean_text(obs).groupBy("file_id", "pos", "Fecha").pivot("series", names).agg(F.first("valor"))
    _write(cells.drop("pos"), path)


def read_clean(spark, path):
    """Read back what ``write_clean`` wrote."""
    schema = "Fecha string, series string, valor string, file_id string"
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


def write_records(records, path):
    """Nested results as JSON lines, partitioned by model."""
    gathered(records, "modelo").write.partitionBy("modelo").json(path)


def write_forecasts(forecasts, path):
    """Flat forecasts as Parquet, partitioned by model."""
    gathered(forecasts, "model").write.partitionBy("model").parquet(path)
