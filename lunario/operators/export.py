"""Shapes of the results: nested records, wide tables and the error table."""

from pyspark.sql import functions as F

from lunario.fixed import ERROR_TITLE, ERROR_TITLE_MEAN, MODEL_DISPLAY
from lunario.functions.calendar import month_label
from lunario.functions.text import percent_text, round_half_even
from lunario.operators.scoring import finite
from lunario.session import values_frame


def point(ds, y):
    return F.struct(month_label(ds).alias("fecha"), round_half_even(y).alias("valor"))


def points(frame, value, keys):
    """One row per key with its points in time order (a point per month)."""
    collected = F.sort_array(F.collect_list(point(F.col("ds"), F.col(value))))
    return frame.groupBy(*keys).agg(collected.alias("points"))


def result_records(forecasts, history, errors, keys=("series",)):
    """Nested result per (series, model): history[], forecast[], mape.

    ``history`` is the panel, ``forecasts`` has one row per series, model and
    month, ``errors`` the chosen set's mape per series and model.
    """
    past = (
        history.groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(point(F.col("ds"), F.col("y")))).alias("historico"),
            F.min(F.year("ds")).alias("anio_inicio"),
        )
    )
    ahead = points(forecasts, "yhat", [*keys, "model"]).withColumnRenamed("points", "pronostico")
    return (
        ahead.join(past, list(keys))
        .join(errors.select(*keys, "model", "mape"), [*keys, "model"], "left")
        .select(
            *keys,
            F.col("model").alias("modelo"),
            "anio_inicio",
            "historico",
            "pronostico",
            F.lit(None).cast("string").alias("intervalo_confianza"),
            F.bround("mape", 2).alias("mape"),
        )
    )


PART_SERIES = 1000


def file_records(published, history, part_series=PART_SERIES):
    """Nested result per file and model: file fields, maps of series to points, mean error.

    ``published`` has one row per file, series, model and forecast month with the
    file's fields, ``history`` the panel. Points are gathered per series first. A
    file of more than ``part_series`` series gives several records, told apart by
    ``parte`` of ``partes``, so that no record grows with the largest file; the error
    is the mean over all series of the file. Values that are no finite number are null.
    """
    keys = ["file_id", "series"]
    fields = ["metric", "scope", "attribute"]
    known = lambda c: finite(F.col(c)).alias(c)
    past = points(history, "y", keys).withColumnRenamed("points", "historico")
    month = F.struct(
        month_label(F.col("ds")).alias("fecha"), round_half_even(finite(F.col("yhat"))).alias("valor"), known("lower"), known("upper")
    )
    ahead = published.groupBy(*keys, *fields, "model").agg(
        F.sort_array(F.collect_list(month)).alias("pronostico"), F.first("mape").alias("mape")
    )
    size = F.count(F.lit(1))
    sizes = ahead.groupBy("file_id", "model").agg(
        F.ceil(size / part_series).cast("int").alias("partes"), F.bround(F.avg(finite(F.col("mape"))), 2).alias("mape")
    )
    first = history.groupBy("file_id").agg(F.min(F.year("ds")).alias("anio_inicio"))
    part = F.pmod(F.xxhash64("series"), F.col("partes")).cast("int").alias("parte")
    entry = F.struct("series", "historico", "pronostico")
    gathered = (
        ahead.drop("mape")
        .join(past, keys, "left")
        .join(sizes, ["file_id", "model"])
        .groupBy("file_id", "model", *fields, "partes", "mape", part)
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        .join(first, "file_id", "left")
    )

    def by_series(field):
        pairs = F.transform("entries", lambda e: F.struct(e["series"], e[field]))
        return F.map_from_entries(pairs).alias(field)

    return gathered.select(
        "file_id",
        F.col("metric").alias("metrica"),
        F.col("scope").alias("modo"),
        F.col("model").alias("modelo"),
        F.col("attribute").alias("atributo"),
        "anio_inicio",
        "parte",
        "partes",
        by_series("historico"),
        by_series("pronostico"),
        "mape",
    )


def file_errors(records):
    """What the error table needs, from the records of files: model, mape, scope and attribute of each file."""
    fields = {"modelo": "model", "modo": "scope", "atributo": "attribute"}
    return records.where("parte = 0").select("file_id", *[F.col(a).alias(b) for a, b in fields.items()], "mape")


def _wide(frame, column, names, value):
    cell = F.first(round_half_even(F.col(value)))
    wide = frame.groupBy("ds").pivot(column, names).agg(cell).orderBy("ds")
    return wide.select(month_label(F.col("ds")).alias("fecha"), *[F.col(f"`{n}`") for n in names])


def export_history_wide(panel, names):
    """Month x series table of rounded history; ``names`` lists the columns."""
    return _wide(panel, "series", names, "y")


def export_forecast_by_model(forecasts, names):
    """Month x series table of rounded forecasts per model."""
    cell = F.first(round_half_even(F.col("yhat")))
    wide = forecasts.groupBy("model", "ds").pivot("series", names).agg(cell).orderBy("model", "ds")
    return wide.select("model", month_label(F.col("ds")).alias("fecha"), *[F.col(f"`{n}`") for n in names])


def export_forecast_by_series(forecasts, models, keys=("series",)):
    """Month x model table of rounded forecasts, models aligned by month."""
    cell = F.first(round_half_even(F.col("yhat")))
    wide = forecasts.groupBy(*keys, "ds").pivot("model", models).agg(cell).orderBy(*keys, "ds")
    return wide.select(*keys, month_label(F.col("ds")).alias("fecha"), *[F.col(f"`{n}`") for n in models])


def error_title(scope, attribute):
    return F.when(
        (scope == "atributo") & (F.coalesce(attribute, F.lit("")) != ""),
        F.concat(F.lit(ERROR_TITLE_MEAN), attribute),
    ).otherwise(F.lit(ERROR_TITLE))


def export_error_table(errors):
    """(model display name, error text, title) for models with an error.

    ``errors`` has model, mape, scope and attribute, and file_id where several files are told apart.
    """
    names = F.broadcast(values_frame(errors.sparkSession, ["model", "display"], list(MODEL_DISPLAY.items())))
    return (
        errors.where(F.col("mape").isNotNull())
        .join(names, "model", "left")
        .select(
            *[c for c in errors.columns if c == "file_id"],
            F.coalesce("display", "model").alias("modelo"),
            percent_text(F.col("mape")).alias("mape_texto"),
            error_title(F.col("scope"), F.col("attribute")).alias("titulo"),
        )
    )
