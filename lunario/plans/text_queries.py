"""Text cleaning, names and registry lookups over whole tables."""

from pyspark.sql import functions as F

from lunario.functions import text
from lunario.operators import registry
from lunario.plans.frames import messy_orders, series_files, table
from lunario.plans.registry import query
from lunario.sources.delimited import split_rejects
from lunario.sources.names import parse_series_name


@query(
    "normalize_month",
    """SELECT o_orderkey,
       strftime(CASE WHEN o_orderkey % 7 = 6 AND year(o_orderdate) < 2000
                     THEN o_orderdate + INTERVAL 100 YEAR ELSE o_orderdate END, '%Y-%m') AS ds
FROM orders""",
)
def normalize_month(spark, sf):
    return text.with_month(messy_orders(spark, sf), "fecha_raw").select("o_orderkey", "ds")


@query(
    "month_name_lookup",
    """SELECT o_orderkey,
       CASE WHEN o_orderkey % 7 IN (4, 5, 6) THEN CAST(month(o_orderdate) AS INTEGER) END AS month
FROM orders""",
)
def month_name_lookup(spark, sf):
    word = F.regexp_extract("fecha_raw", r"^(\p{L}+)", 1)
    return messy_orders(spark, sf).select("o_orderkey", text.month_of_name(word).alias("month"))


@query(
    "clean_number",
    """SELECT o_orderkey,
       CASE WHEN o_orderkey % 4 = 3 THEN CAST(round_even(o_totalprice, 0) AS DOUBLE) ELSE o_totalprice END AS valor
FROM orders""",
)
def clean_number(spark, sf):
    return text.with_value(messy_orders(spark, sf), "valor_raw", "valor").select("o_orderkey", "valor")


@query(
    "coerce_numeric",
    """WITH r AS (SELECT *, CAST(round_even(o_totalprice, 0) AS DOUBLE) AS whole FROM orders)
SELECT o_orderkey,
       CASE WHEN o_orderkey % 4 = 2 THEN o_totalprice
            WHEN o_orderkey % 4 = 3 AND whole < 1000 THEN whole
            WHEN o_orderkey % 4 = 3 AND whole < 1000000 THEN whole / CAST(1000 AS DOUBLE) END AS valor
FROM r""",
)
def coerce_numeric(spark, sf):
    """Coercion alone, without cleaning: only plain decimals survive."""
    return messy_orders(spark, sf).select("o_orderkey", text.coerce_number(F.col("valor_raw")).alias("valor"))


@query(
    "missing_markers",
    """SELECT o_orderkey, o_orderkey % 11 < 5 AS is_missing,
       CASE WHEN o_orderkey % 11 < 5 THEN NULL
            WHEN o_orderkey % 4 = 3 THEN CAST(round_even(o_totalprice, 0) AS DOUBLE)
            ELSE o_totalprice END AS valor
FROM orders""",
)
def missing_markers(spark, sf):
    markers = F.array(*[F.lit(m) for m in ["'-", "", " NA ", "-", "N/A"]])
    at = (F.col("o_orderkey") % 11).cast("int")
    raw = F.coalesce(F.get(markers, at), F.col("valor_raw"))
    return messy_orders(spark, sf).select(
        "o_orderkey", text.is_missing(raw).alias("is_missing"), text.clean_number(raw).alias("valor")
    )


@query(
    "reject_rows",
    """SELECT o_orderkey,
       CASE WHEN o_orderkey % 13 IN (0, 1) THEN 'bad_date' ELSE 'bad_number' END AS reason
FROM orders WHERE o_orderkey % 13 IN (0, 1) OR o_orderkey % 17 = 0""",
)
def reject_rows(spark, sf):
    key = F.col("o_orderkey")
    damaged = messy_orders(spark, sf).select(
        "o_orderkey",
        F.when(key % 13 == 0, "sept 2012").when(key % 13 == 1, "2020-99").otherwise(F.col("fecha_raw")).alias("f"),
        F.when(key % 17 == 0, "12,345.67").when(key % 17 == 1, "'-").otherwise(F.col("valor_raw")).alias("raw"),
    )
    parsed = text.with_value(text.with_month(damaged, "f"), "raw")
    return split_rejects(parsed)[1].select("o_orderkey", "reason")


@query(
    "round_half_even",
    """SELECT o_orderkey,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL
            ELSE CAST(round_even(o_orderkey + CAST(0.5 AS DOUBLE), 0) AS BIGINT) END AS tie,
       CAST(round_even(o_totalprice, 0) AS BIGINT) AS price
FROM orders""",
)
def round_half_even(spark, sf):
    tie = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey") + F.lit(0.5).cast("double"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        text.round_half_even(tie).alias("tie"),
        text.round_half_even(F.col("o_totalprice")).alias("price"),
    )


FILE_FIELDS = """files AS (
  SELECT c_custkey, c_name, c_mktsegment,
    ['Parados', 'Afiliados', 'Demandantes', 'Contratos', 'P. contratadas', 'Personas Contratadas',
     'Empleo'][c_custkey % 7 + 1] AS metric,
    CASE WHEN c_custkey % 4 = 0 THEN 'estatal' ELSE 'atributo' END AS scope,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS attribute,
    ['NP', 'LSTM', 'XGBoost', 'ARIMA'][(c_custkey // 7) % 4 + 1] AS model,
    CAST(c_custkey % 30 + 1990 AS INTEGER) AS start_year,
    CAST(CASE WHEN c_custkey % 5 = 0 THEN 2028 END AS INTEGER) AS horizon_end
  FROM customer), named AS (
  SELECT c_custkey, c_name, c_mktsegment, model,
         CASE WHEN c_custkey % 9 <> 8 THEN metric END AS metric, CASE WHEN c_custkey % 9 <> 8 THEN scope END AS scope,
         CASE WHEN c_custkey % 9 <> 8 THEN attribute END AS attribute,
         CASE WHEN c_custkey % 9 <> 8 THEN start_year END AS start_year,
         CASE WHEN c_custkey % 9 <> 8 THEN horizon_end END AS horizon_end
  FROM files), sheets AS (
  SELECT c_custkey, c_name || '/' || c_mktsegment || coalesce(':' || metric, '') AS sheet FROM named), grouped AS (
  SELECT *, CASE WHEN lower(metric) IN ('parados', 'afiliados', 'demandantes') THEN 'abc'
                 WHEN lower(metric) IN ('contratos', 'p. contratadas', 'personas contratadas') THEN 'de'
            END AS metric_group FROM named)"""

MODEL_OK = """((metric_group = 'abc' AND model IN ('NP', 'LSTM')) OR
   (metric_group = 'de' AND model IN ('NP', 'XGBoost')))"""


def parsed_files(spark, sf):
    return series_files(spark, sf).select("*", parse_series_name(F.col("file_name")).alias("f")).select("*", "f.*").drop("f")


@query(
    "parse_series_name",
    f"""WITH {FILE_FIELDS}
SELECT f.c_custkey, n.metric, n.start_year, n.scope, n.attribute, n.horizon_end
FROM files f LEFT JOIN named n USING (c_custkey)""",
)
def parse_names(spark, sf):
    return parsed_files(spark, sf).select("c_custkey", "metric", "start_year", "scope", "attribute", "horizon_end")


@query(
    "sanitize_names",
    f"""WITH {FILE_FIELDS}
SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9_]', '_', 'g') AS safe,
       replace(replace(CASE WHEN length(s.sheet) > 31 THEN substr(s.sheet, 1, 22) || '_' || substr(md5(s.sheet), 1, 8)
                            ELSE s.sheet END, '/', '_'), ':', '_') AS sheet,
       'Pronostico_' || regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') || '_' ||
         CASE WHEN scope = 'atributo' THEN 'por_' || attribute ELSE scope END || '_' || model || '_Ensemble.xlsx'
         AS export_name
FROM named JOIN sheets AS s USING (c_custkey)""",
)
def sanitize_names(spark, sf):
    files = parsed_files(spark, sf)
    sheet = F.concat_ws(":", F.concat_ws("/", "c_name", "c_mktsegment"), "metric")
    return files.select(
        "c_custkey",
        text.sanitize_name(F.col("c_name")).alias("safe"),
        text.sheet_name(sheet).alias("sheet"),
        # a name that does not parse has no export
        F.when(
            F.col("metric").isNotNull(),
            text.export_name(F.col("metric"), F.col("scope"), F.col("attribute"), F.array("model", F.lit("Ensemble"))),
        ).alias("export_name"),
    )


@query("metric_group_lookup", f"WITH {FILE_FIELDS}\nSELECT c_custkey, metric, metric_group FROM grouped")
def metric_group_lookup(spark, sf):
    return registry.with_metric_group(parsed_files(spark, sf)).select("c_custkey", "metric", "metric_group")


def _requests(spark, sf):
    files = registry.with_metric_group(parsed_files(spark, sf))
    return files.select("c_custkey", "metric_group", "scope", "model")


@query(
    "model_registry_join",
    f"WITH {FILE_FIELDS}\nSELECT c_custkey, metric_group, scope, model FROM grouped WHERE {MODEL_OK}",
)
def model_registry_join(spark, sf):
    return registry.available_models(_requests(spark, sf)).select("c_custkey", "metric_group", "scope", "model")


@query(
    "model_registry_anti",
    f"""WITH {FILE_FIELDS}
SELECT c_custkey, metric_group, scope, model FROM grouped
WHERE metric_group IS NULL OR NOT {MODEL_OK}""",
)
def model_registry_anti(spark, sf):
    return registry.unavailable_models(_requests(spark, sf)).select("c_custkey", "metric_group", "scope", "model")
