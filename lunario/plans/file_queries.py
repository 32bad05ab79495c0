"""File scans and what is read off them."""

from pyspark.sql import functions as F

from lunario.functions.text import coerce_number
from lunario.plans.frames import FILES, SEGMENTS, block_observations, file_cells, wide_text
from lunario.plans.registry import query
from lunario.session import scratch_path, written
from lunario.sources import delimited, sinks
from lunario.sources.names import base_name

WIDE_ROWS = """wide AS (
  SELECT c_nationkey % 4 AS grp, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, c_mktsegment AS segment,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) // 100 AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3), segs AS (
  SELECT * FROM (VALUES (0, 'AUTOMOBILE'), (1, 'BUILDING'), (2, 'FURNITURE'), (3, 'HOUSEHOLD'), (4, 'MACHINERY'))
           AS s(i, segment)), grid AS (
  SELECT * FROM (SELECT DISTINCT grp, ds FROM wide) CROSS JOIN segs), obs AS (
  SELECT grp, ['Contratos desde 1995 por sector.csv', 'Parados desde 1995 por sector.csv',
               'Afiliados desde 1995 estatal.csv', 'P. contratadas desde 1995 estatal.csv'][grp + 1] AS file_id,
         g.ds, g.segment, g.i,
         CASE WHEN (month(g.ds) + year(g.ds) + g.i) % 7 = 0 THEN NULL
              WHEN month(g.ds) % 3 = 1 THEN amount + CAST(0.5 AS DOUBLE)
              ELSE CAST(amount AS DOUBLE) END AS y
  FROM grid g LEFT JOIN wide w USING (grp, ds, segment))"""

ACCENT = "Región "


def named():
    """The file's name alone, as the check SQL has it."""
    return base_name(F.col("file_id")).alias("file_id")


def write_files(spark, sf, groups=(0, 1, 2, 3), date_last=(), mark="; total"):
    """Write T5 as delimited files in a fresh folder of the scratch space.

    Even groups use ``;``, odd ones tabs; groups 2 and 3 are Latin-1 with
    accented column names. Groups in ``date_last`` put the date column last.
    """
    base = scratch_path(spark, "files")
    rows = written(wide_text(spark, sf), "wide_text")
    for group in groups:
        prefix = ACCENT if group >= 2 else ""
        data = [F.col(s).alias(prefix + s + mark) for s in SEGMENTS]
        date = F.col("fecha_raw").alias("DATE" if group in date_last else "Fecha")
        columns = [*data, date] if group in date_last else [date, *data]
        (
            rows.where(F.col("grp") == group)
            .select(*columns)
            .write.option("header", True)
            .option("sep", "\t" if group % 2 else ";")
            .option("encoding", "ISO-8859-1" if group >= 2 else "UTF-8")
            .csv(f"{base}/{FILES[group]}")
        )
    return f"{base}/*.csv"


@query(
    "scan_delimited",
    f"""WITH {WIDE_ROWS}
SELECT file_id, CASE WHEN grp >= 2 THEN 'Región ' ELSE '' END || segment || '; total' AS series, CAST(i + 1 AS INTEGER) AS col_pos, strftime(ds, '%Y-%m') AS ds, y
FROM obs""",
)
def scan_delimited(spark, sf):
    obs = delimited.read_series_files(spark, write_files(spark, sf))
    return obs.select(named(), "series", "col_pos", "ds", "y")


@query(
    "scan_records",
    f"""WITH {WIDE_ROWS}
SELECT file_id, CASE WHEN grp >= 2 THEN 'Región ' ELSE '' END || segment || chr(10) || 'total' AS series,
       strftime(ds, '%Y-%m') AS ds, y
FROM obs""",
)
def scan_records(spark, sf):
    """Headers in quotes with line breaks, in every separator and encoding."""
    obs = delimited.read_series_files(spark, write_files(spark, sf, mark="\ntotal"))
    return obs.select(named(), "series", "ds", "y")


@query(
    "scan_encoding",
    f"""WITH {WIDE_ROWS}
SELECT file_id, CASE WHEN grp >= 2 THEN 'Región ' ELSE '' END || segment AS series,
       strftime(ds, '%Y-%m') AS ds, y
FROM obs""",
)
def scan_encoding(spark, sf):
    obs = delimited.read_series_files(spark, write_files(spark, sf, mark=""))
    return obs.select(named(), "series", "ds", "y")


@query(
    "detect_date_column",
    f"""WITH {WIDE_ROWS}
SELECT file_id, CASE WHEN grp IN (1, 2) THEN 6 ELSE 1 END AS date_pos,
       CASE WHEN grp IN (1, 2) THEN 'DATE' ELSE 'Fecha' END AS date_header, count(DISTINCT ds) AS n_rows
FROM obs GROUP BY ALL""",
)
def detect_date_column(spark, sf):
    rows = delimited.read_rows(spark, write_files(spark, sf, date_last=(1, 2)))
    date_pos = delimited.date_position(F.col("header"))
    return (
        rows.select(named(), date_pos.alias("date_pos"), F.get("header", date_pos - 1).alias("date_header"))
        .groupBy("file_id", "date_pos", "date_header")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@query(
    "write_clean",
    f"""WITH {WIDE_ROWS}
SELECT file_id, '01/' || strftime(ds, '%m/%Y') AS fecha, segment AS series, y FROM obs""",
)
def write_clean(spark, sf):
    """Clean, write with ``;`` and day-one dates, read back as plain numbers."""
    path = scratch_path(spark, "clean")
    sinks.write_clean(file_cells(spark, sf), path)
    return sinks.read_clean(spark, path).select(
        "file_id", F.col("Fecha").alias("fecha"), "series", coerce_number(F.col("valor")).alias("y")
    )


@query(
    "pick_first_series",
    f"""WITH {WIDE_ROWS}
SELECT file_id, segment AS series, strftime(ds, '%Y-%m') AS ds, y FROM obs WHERE i = 0""",
)
def pick_first_series(spark, sf):
    return delimited.pick_first_series(file_cells(spark, sf)).select("file_id", "series", "ds", "y")


BLOCKS = """blocks AS (
  SELECT 'Contratos desde 1995 por bloque.csv' AS file_id, o_custkey % 60 AS block, 60 AS width,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y
  FROM orders GROUP BY ALL
  UNION ALL
  SELECT 'Contratos desde 1995 por sector.csv', o_custkey % 5, 5,
         CAST(date_trunc('month', o_orderdate) AS DATE), CAST(count(*) AS DOUBLE)
  FROM orders GROUP BY ALL)"""


@query(
    "select_series_range",
    f"""WITH {BLOCKS}
SELECT file_id, 'b' || block AS series, CAST(block + 1 AS INTEGER) AS col_pos, strftime(ds, '%Y-%m') AS ds, y
FROM blocks WHERE block + 1 BETWEEN 3 AND 17""",
)
def select_series_range(spark, sf):
    kept = delimited.select_series_range(block_observations(spark, sf), 3, 17)
    return kept.select("file_id", "series", "col_pos", "ds", "y")


@query(
    "wide_file_gate",
    f"""WITH {BLOCKS}
SELECT file_id, CAST(max(width) AS INTEGER) AS n_series, max(width) > 53 AS needs_range
FROM blocks GROUP BY file_id""",
)
def wide_file_gate(spark, sf):
    return delimited.wide_file_gate(block_observations(spark, sf))


@query("last_month", f"WITH {WIDE_ROWS}\nSELECT file_id, strftime(max(ds), '%Y-%m') AS last_ds FROM obs GROUP BY 1")
def last_month(spark, sf):
    return delimited.last_month(file_cells(spark, sf))


@query(
    "history_preview",
    f"""WITH {WIDE_ROWS}
SELECT file_id, segment AS series, strftime(ds, '%Y-%m') AS fecha,
       CAST(round_even(y, 0) AS BIGINT) AS valor
FROM obs""",
)
def history_preview(spark, sf):
    return delimited.history_preview(file_cells(spark, sf))
