"""Metadata carried by file names, and where a line's file name comes from."""

from pyspark.sql import functions as F

from lunario.functions.text import strip

# "<metric> desde <year> estatal" or "<metric> desde <year> por <attribute>",
# with an optional trailing "<year>-<year>" (fixed format).
SERIES_NAME = r"(?iU)^(.+?)\s+desde\s+(\d{4})\s+(estatal|por\s+(.+?))(?:\s+(\d{4})-(\d{4}))?$"


def parse_series_name(name):
    """Struct of the fields in a file name; all null when it does not match."""
    stem = F.regexp_replace(name, r"(?i)\.csv$", "")
    ok = stem.rlike(SERIES_NAME)

    def field(group):
        text = strip(F.regexp_extract(stem, SERIES_NAME, group))
        return F.when(ok & (text != ""), text)

    national = F.lower(field(3)) == "estatal"
    return F.struct(
        field(1).alias("metric"),
        field(2).try_cast("int").alias("start_year"),
        F.when(national, "estatal").when(ok, "atributo").alias("scope"),
        field(4).alias("attribute"),
        field(5).try_cast("int").alias("horizon_start"),
        field(6).try_cast("int").alias("horizon_end"),
    )


def logical_file(path):
    """The path of the ``.csv`` file a physical path belongs to; other paths as they are.

    A folder called ``x.csv`` holding part files counts as the file ``x.csv``; a
    folder ``file_id=...`` stands for the path that it names.
    """
    plus = lambda text: F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    decoded = plus(path)
    named = F.regexp_extract(decoded, r"(?i)/file_id=([^/]+\.csv)(?:/[^/]*)?$", 1)
    plain = F.regexp_extract(decoded, r"(?i)^(.*?[^/]\.csv)(?:/[^/]*)?$", 1)
    return F.when(named != "", plus(named)).when(plain != "", plain).otherwise(decoded)


def base_name(file_id):
    return F.regexp_extract(file_id, r"[^/]*$", 0)


def with_file_metadata(obs):
    """Add the parsed file-name fields to observations."""
    return obs.withColumn("name", parse_series_name(base_name(F.col("file_id")))).select("*", "name.*").drop("name")
