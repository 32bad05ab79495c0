"""Records that span lines: cells in quotes may hold line breaks.

Whether a line starts inside quotes depends on all lines before it. A line acts on
that state as one of four functions: it leaves it, flips it, or ends outside or
inside whatever it was. Such functions compose, so the state is found by a prefix
scan: over the lines of each block first, then over the blocks of a file, which are
few, and no task needs more than a block. A running state is the latest fixed end
flipped by the number of flips since, or the start flipped by all of them.

Lines that start outside open a record; the others go to the record that an earlier
line, of this block or one before, has opened. Only files that have a line which
does not leave the state alone are treated at all.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

# A cell that opens with a quote runs to the closing one, doubled quotes inside;
# possessive, so that a line is read once.
_INSIDE = r'(?:[^"]|"")*+'


def _open_at_end(line, sep):
    """Whether a line that starts outside quotes ends inside."""
    cell = rf'(?:"{_INSIDE}"[^{sep}]*+|[^"{sep}][^{sep}]*+|)'
    return line.rlike(rf'(?s)^(?:{cell}{sep})*+"{_INSIDE}$')


def _still_open(line, sep):
    """Whether a line that starts inside quotes ends inside."""
    rest = F.regexp_replace(line, rf'(?s)^{_INSIDE}"[^{sep}]*+{sep}?', "")
    return ~line.rlike(rf'(?s)^{_INSIDE}"') | _open_at_end(rest, sep)


def quote_ends(line, sep):
    """(end of a line that starts outside, end of one that starts inside quotes), true for inside."""
    quoted = line.contains('"')
    return (
        F.when(quoted, _open_at_end(line, sep)).otherwise(False),
        F.when(quoted, _still_open(line, sep)).otherwise(True),
    )


def spans_lines(line, sep):
    """Whether a line has any effect on what follows it."""
    outside, inside = quote_ends(line, sep)
    return outside | ~inside


def _scan(window, flip, fixed):
    """State after each row of ``window`` as (value known without the start, flips of the start); see the module's head."""
    flips = F.sum(flip.cast("int")).over(window) % 2
    # what a start would have to be for the flips alone to lead to the fixed end
    anchor = F.last(F.when(fixed.isNotNull(), (fixed.cast("int") + flips) % 2), ignorenulls=True).over(window)
    return F.when(anchor.isNotNull(), (anchor + flips) % 2), flips


def joined_records(lines):
    """(records, open lines) of ``lines`` (path, pos, value, sep): both in the shape path, pos, value.

    A record has the position of its first line; its lines are joined by a line
    feed. Open lines are the one that opens quotes which a file never closes, and
    all after it: they are no records.
    """
    semicolon, tab = quote_ends(F.col("value"), ";"), quote_ends(F.col("value"), "\t")
    ends = [F.when(F.col("sep") == "\t", t).otherwise(s) for s, t in zip(semicolon, tab)]
    marked = lines.select(
        "path", "pos", "value", F.col("pos.block").alias("block"), ends[0].alias("from_outside"), ends[1].alias("from_inside")
    )
    block = Window.partitionBy("path", "block").orderBy("pos")
    flip = F.col("from_outside") & ~F.col("from_inside")
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    known, flips = _scan(block, flip, fixed)
    after = marked.select("path", "pos", "value", "block", known.alias("known"), flips.alias("flips"))

    # one row a block: what it does to the state, then the state each block starts with
    whole = after.groupBy("path", "block").agg(
        F.max_by("known", "pos").alias("known"), F.max_by("flips", "pos").alias("flips")
    )
    ordered = Window.partitionBy("path").orderBy("block")
    end, turns = _scan(ordered, F.col("known").isNull() & (F.col("flips") == 1), F.col("known").cast("boolean"))
    state = F.coalesce(end, turns)  # a file starts outside
    starts = whole.select(
        "path", "block", F.coalesce(F.lag(state).over(ordered), F.lit(0)).alias("start"), (state == 1).alias("open_after"),
        F.row_number().over(Window.partitionBy("path").orderBy(F.desc("block"))).alias("from_last"),
    )
    never = starts.where("from_last = 1").select("path", F.col("open_after").alias("never_closes"))
    ended = F.coalesce("known", (F.col("start") + F.col("flips")) % 2)
    placed = after.join(starts.select("path", "block", "start"), ["path", "block"]).withColumn("ended", ended)
    began = F.coalesce(F.lag("ended").over(block), F.col("start"))
    opening = placed.withColumn("opens", F.when(began == 0, F.col("pos")))
    in_block = opening.withColumn("record", F.last("opens", ignorenulls=True).over(block))

    # the record that goes on into a block: the last one that an earlier block opened
    last_of = in_block.groupBy("path", "block").agg(F.max("opens").alias("last_opened"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of.select(
        "path", "block", F.last("last_opened", ignorenulls=True).over(before).alias("carried"),
        F.max("last_opened").over(Window.partitionBy("path")).alias("last_record"),
    )
    joined = in_block.join(carried, ["path", "block"]).join(never, "path")
    owned = joined.withColumn("record", F.coalesce("record", "carried"))
    unclosed = F.col("never_closes") & (F.col("record") == F.col("last_record"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "value")))
    records = (
        owned.where(~unclosed)
        .groupBy("path", "record")
        .agg(F.array_join(parts["value"], "\n").alias("value"))
        .select("path", F.col("record").alias("pos"), "value")
    )
    return records, owned.where(unclosed).select("path", "pos", "value")
