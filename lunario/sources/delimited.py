"""Reading of delimited files with differing headers, separators and encodings.

Lines are read with the text source, so a large file is split over tasks. One
pass profiles every physical file (header line, encoding, separator); the
profile is one row per file, written to the shared folder so that the join
back to the lines sees its true size. Files with cells that hold line breaks are
brought to one line a record first (``quoting``).
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lunario.fixed import DATE_HEADERS, WIDE_GATE
from lunario.functions import text
from lunario.functions.calendar import month_label
from lunario.functions.columns import computed_once
from lunario.session import written
from lunario.sources.names import logical_file
from lunario.sources.quoting import joined_records, spans_lines

BOM = "﻿"
NO_ROWS = 0  # position of the one observation of a file without values
REPEATED_HEADER, OPEN_QUOTE = -1, -2  # positions of observations that are whole lines
LINE_REJECTS = {NO_ROWS: "no_rows", REPEATED_HEADER: "repeated_header", OPEN_QUOTE: "open_quote"}
YEARS = (1000, 2999)  # a month outside is a mistyped one

# A cell is everything after a separator up to the next one; a cell that opens
# with a quote runs to its closing quote.
QUOTED_CELLS = {
    ";": r';("[^"]*(?:""[^"]*)*"|[^;]*)',
    "\t": r'\t("[^"]*(?:""[^"]*)*"|[^\t]*)',
}


def read_lines(spark, path):
    """Raw lines with the physical file and a position that orders them in it."""
    return with_position(spark.read.text(path).select("value", *FILE_FIELDS))


FILE_FIELDS = ["_metadata.file_path", "_metadata.file_block_start"]


def with_position(lines):
    return lines.select(
        F.col("file_path").alias("path"),
        F.struct(
            F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
        ).alias("pos"),
        "value",
    )


def decoded(value, utf8):
    """Text of a raw line: UTF-8, or Latin-1 when its file is not valid UTF-8."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.when(utf8, value).otherwise(latin)


def profile_files(lines):
    """One row per physical file: header, its position, encoding, separator."""
    per_file = lines.groupBy("path").agg(
        F.min_by("value", "pos").alias("raw_header"),
        F.min("pos").alias("header_pos"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.count_if(text.strip(F.col("value")) != "").alias("n_lines"),
        F.bool_or(spans_lines(F.col("value"), ";")).alias("spans_semicolon"),
        F.bool_or(spans_lines(F.col("value"), "\t")).alias("spans_tab"),
    )
    header = F.replace(decoded(F.col("raw_header"), F.col("utf8")), F.lit(BOM), F.lit(""))
    found = per_file.select(
        "path",
        "raw_header",
        "header_pos",
        "utf8",
        "n_lines",
        header.alias("text"),
        F.when(header.contains("\t"), "\t").otherwise(";").alias("sep"),
        F.when(header.contains("\t"), F.col("spans_tab")).otherwise(F.col("spans_semicolon")).alias("spans"),
    )
    cells = computed_once(found, {"cells": F.transform(split_cells(F.col("text"), F.col("sep")), text.strip)})
    return cells.select("*", distinct_names(F.col("cells")).alias("header")).drop("text", "cells")


def whole_records(lines, files):
    """(lines, files, open lines) with one line a record, given the profile of the files.

    Open lines are those that a file's last quotes, never closed, run over; None
    where no file has cells that span lines.
    """
    if files.where("spans").isEmpty():
        return lines, files, None
    of_lines = files.where("spans").select("path", "sep")
    records, unclosed = joined_records(lines.join(of_lines, "path"))
    # written: positions must not change between the profile of the records and their reading
    records = written(records.withColumn("closed", F.lit(True)).unionByName(unclosed.withColumn("closed", F.lit(False))), "records")
    made = records.where("closed").drop("closed")
    profile = written(profile_files(made), "file_profile")
    rest = lines.join(of_lines.select("path"), "path", "left_anti").select("path", "pos", "value")
    return rest.unionByName(made), files.where(~F.col("spans")).unionByName(profile), records.where("not closed").drop("closed")


def line_rejects(lines, position):
    """One observation, a reject, for every one of ``lines`` (path, pos, text)."""
    nothing = F.lit(None).cast("string")
    return lines.select(
        logical_file(F.col("path")).alias("file_id"), "pos", nothing.alias("series"), F.lit(position).alias("col_pos"),
        F.lit(0).alias("n_series"), nothing.alias("fecha_raw"), F.lit(None).cast("date").alias("ds"), F.col("text").alias("raw"),
    )


def distinct_names(cells):
    """A name that stands to the left already gets its number of times appended: A, A.1, A.2."""

    def name(cell, i):
        before = F.size(F.filter(F.slice(cells, 1, i), lambda c: c == cell))
        return F.when(before > 0, F.concat(cell, F.lit("."), before.cast("string"))).otherwise(cell)

    return F.transform(cells, name)


def split_cells(line, sep):
    """Cells of a line, quotes honoured."""

    def quoted(mark):
        cells = F.regexp_extract_all(F.concat(F.lit(mark), line), F.lit(QUOTED_CELLS[mark]), F.lit(1))
        return F.transform(cells, _unquoted)

    def cells(mark):
        return F.when(line.contains('"'), quoted(mark)).otherwise(F.split(line, mark))

    return F.when(sep == "\t", cells("\t")).otherwise(cells(";"))


def _unquoted(cell):
    inner = F.substring(cell, F.lit(2), F.length(cell) - 2)
    return F.when(cell.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(cell)


def date_position(header):
    """1-based position of the date column; the first column when none is named."""
    named = F.transform(header, lambda h: F.lower(text.strip(h)).isin(DATE_HEADERS))
    return F.greatest(F.array_position(named, True), F.lit(1)).cast("int")


def cells_long(rows):
    """Explode rows of (file_id, pos, header[], cells[]) to one row per value cell."""
    date_pos = date_position(F.col("header"))
    found = rows.withColumn("date_pos", date_pos).withColumn("fecha_raw", F.get("cells", F.col("date_pos") - 1))
    # the month is read once per row, before it becomes one row per cell
    located = text.with_month(found, "fecha_raw").select(
        "file_id",
        "pos",
        "date_pos",
        (F.size("header") - 1).alias("n_series"),
        "fecha_raw",
        "ds",
        F.posexplode(F.arrays_zip("header", "cells")).alias("at", "cell"),
    )
    # cells beyond the header have no series; only those that say something are kept, as rejects
    surplus = F.col("cell.header").isNull()
    told = ~surplus | (text.strip(F.col("cell.cells")) != "")
    return located.where((F.col("at") + 1 != F.col("date_pos")) & told).select(
        "file_id",
        "pos",
        text.strip(F.col("cell.header")).alias("series"),
        # value columns numbered from 1, the date column not counted
        (F.col("at") + F.when(F.col("at") + 1 < F.col("date_pos"), 1).otherwise(0)).alias("col_pos"),
        "n_series",
        "fecha_raw",
        "ds",
        F.col("cell.cells").alias("raw"),
    )


def read_rows(spark, path):
    """Data rows of every file under ``path`` as header and cell arrays."""
    return rows_of(read_lines(spark, path))


def rows_of(lines):
    lines, files, _ = whole_records(lines, written(profile_files(lines), "file_profile"))
    return rows_with(lines, files)[0]


def rows_with(lines, files):
    """(data rows, lines that repeat the header) of ``lines``, given the profile of their files.

    A file's first line is its header. Line numbers depend on how a scan packs
    files, so lines that equal it are ranked in this pass: the first one in the
    first block goes, the others are rejects. They are few; no other line is
    shuffled for it.
    """
    plain = lambda c: F.replace(F.col(c), F.lit(BOM), F.lit(""))
    known = lines.join(files, "path").where(text.strip(F.col("value")) != "")
    same = plain("value").eqNullSafe(plain("raw_header"))
    data = known.where(~same).select(
        logical_file(F.col("path")).alias("file_id"),
        "pos",
        "header",
        split_cells(decoded(F.col("value"), F.col("utf8")), F.col("sep")).alias("cells"),
    )
    place = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    equal = known.where(same).select("path", "pos", decoded(F.col("value"), F.col("utf8")).alias("text"), place.alias("place"))
    return data, equal.where("place > 1").drop("place")


def without_values(files):
    """One observation, a reject, for every file that has no data rows or no column but the date."""
    empty = files.where((F.col("n_lines") < 2) | (F.size("header") < 2))
    return empty.select(
        logical_file(F.col("path")).alias("file_id"),
        F.col("header_pos").alias("pos"),
        F.lit(None).cast("string").alias("series"),
        F.lit(NO_ROWS).alias("col_pos"),
        F.lit(0).alias("n_series"),
        F.lit(None).cast("string").alias("fecha_raw"),
        F.lit(None).cast("date").alias("ds"),
        F.lit(None).cast("string").alias("raw"),
    )


def read_series_files(spark, path):
    """Observations (raw texts, parsed month and value) of all files under ``path``."""
    return observations(read_lines(spark, path))


def observations(lines):
    lines, files, unclosed = whole_records(lines, written(profile_files(lines), "file_profile"))
    data, repeated = rows_with(lines, files)
    found = cells_long(data).unionByName(without_values(files)).unionByName(line_rejects(repeated, REPEATED_HEADER))
    if unclosed is not None:
        found = found.unionByName(line_rejects(unclosed.withColumnRenamed("value", "text"), OPEN_QUOTE))
    return parse_cells(found)


def parse_cells(cells):
    return text.with_value(cells, "raw")


def split_rejects(obs):
    """(accepted, rejected) observations; a missing marker is not a reject."""
    bad_number = F.col("y").isNull() & ~text.is_missing(F.col("raw"))
    reason = F.when(F.col("ds").isNull(), "bad_date").when(bad_number, "bad_number")
    if {"col_pos", "series"} <= set(obs.columns):
        of_line = F.try_element_at(F.create_map(*[F.lit(v) for kv in LINE_REJECTS.items() for v in kv]), F.col("col_pos"))
        reason = F.coalesce(of_line, F.when(F.col("series").isNull(), "extra_cells"), reason)
    if "ds" in obs.columns:
        year = F.year("ds")
        reason = F.coalesce(reason, F.when(~year.between(*YEARS), "bad_year"))
    marked = obs.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def pick_first_series(obs):
    """Keep each file's first value column only (files with one national series)."""
    return obs.where(F.col("col_pos") == 1)


def wide_file_gate(obs, gate=WIDE_GATE):
    """Value-column count per file and whether a column range is needed."""
    return (
        obs.groupBy("file_id")
        .agg(F.max("n_series").alias("n_series"))
        .withColumn("needs_range", F.col("n_series") > gate)
    )


def select_series_range(obs, lo, hi):
    """Keep value columns ``lo..hi`` of every file, whatever its width."""
    return obs.where(F.col("col_pos").between(lo, hi))


def last_month(obs):
    """Latest readable month of each file."""
    return obs.groupBy("file_id").agg(F.max("ds").alias("last_ds"))


def history_preview(obs):
    """(file, series, month label, rounded value or null); unreadable months dropped."""
    return obs.where(F.col("ds").isNotNull()).select(
        "file_id",
        "series",
        month_label(F.col("ds")).alias("fecha"),
        text.round_half_even(F.col("y")).alias("valor"),
    )


def month_panel(obs, keys=("file_id", "series")):
    """Long panel with one row per series and month; the last row of a file wins."""
    return (
        obs.where(F.col("ds").isNotNull())
        .groupBy(*keys, "ds")
        .agg(F.max_by("y", "pos").alias("y"))
    )
