"""Helpers on whole column sets."""

from pyspark.sql import functions as F


def computed_once(df, columns):
    """Add columns that are evaluated once per row.

    The optimizer copies a projected expression into every filter and
    projection that uses it; for text parsing that repeats regular expressions
    many times. Columns produced by a generator are not copied.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))
