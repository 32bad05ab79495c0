"""Parameter grids and their combination with series and folds."""

import itertools

from pyspark.sql import functions as F



def grid_rows(grid):
    """Parameter sets in order: names alphabetical, the last one varying fastest."""
    names = sorted(grid)
    return names, list(itertools.product(*(grid[n] for n in names)))


def _set_columns(grid):
    """Number of sets, and each parameter's value as an expression of ``param_id``: sets count like digits."""
    stride, columns = 1, []
    for name in sorted(grid, reverse=True):
        values = grid[name]
        place = (F.floor(F.col("param_id") / stride) % len(values)).cast("int")
        columns.append(F.get(F.array(*map(F.lit, values)), place).alias(name))
        stride *= len(values)
    return stride, columns[::-1]


def param_grid(spark, grid):
    """Grid as a table with ``param_id`` in that order, of any size."""
    n, columns = _set_columns(grid)
    return spark.range(n).select(F.col("id").cast("int").alias("param_id")).select("param_id", *columns)


def with_params(rows, grid):
    """Every row once per parameter set, by exploding a sequence (no join)."""
    n, columns = _set_columns(grid)
    numbered = rows.withColumn("param_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return numbered.select("*", *columns)


def fold_table(spans, train, val, step):
    """Fold boundaries per series from its month count ``n``."""
    size = train + val
    starts = F.when(
        F.col("n") >= size, F.sequence(F.lit(0), F.floor((F.col("n") - size) / step).cast("int"))
    )
    return spans.withColumn("fold_id", F.explode(starts)).select(
        "*",
        (F.col("fold_id") * step).alias("start_idx"),
        F.lit(train).alias("train_n"),
        F.lit(val).alias("val_n"),
    )


def tuning_grid(spans, grid, train, val, step):
    """Series x folds x parameter sets: the list of fits to make."""
    return with_params(fold_table(spans, train, val, step), grid)
