"""Many regressions in one job.

Design columns are Spark expressions. Each (series, fold, parameter set) then
gathers its training rows; at most one row per month, so a group is short by
construction. The rows are already partitioned by series, so this needs no
shuffle. Only the p x p solve runs in Python, on Arrow batches of fits.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

BASE_RIDGE = 1e-9


def dot(x, y):
    """Inner product of two array columns; null when a factor is null."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def ridge_solver(ridge):
    """Least squares with one ridge term per column, for a batch of fits."""
    p, diagonal = len(ridge), np.diag(np.asarray(ridge, dtype=float))

    @F.pandas_udf("array<double>")
    def solve(design: pd.Series, values: pd.Series) -> pd.Series:
        coefs = []
        for x, y in zip(design, values):
            if len(y) == 0:
                coefs.append(None)
                continue
            x = np.asarray(x, dtype=float).reshape(-1, p)
            coefs.append(np.linalg.solve(x.T @ x + diagonal, x.T @ np.asarray(y, dtype=float)))
        return pd.Series(coefs)

    return solve


def fit(rows, by, terms, target, usable, ridge, gather):
    """Coefficients per group.

    ``terms`` are the design columns and ``target`` the regressand (SQL
    expressions), ``usable`` a boolean column marking training rows. ``ridge``
    has one penalty per term and ``gather`` further aggregates to keep.
    Returns the groups with ``train`` (x, v and month of the training rows)
    and ``coef``; groups without usable rows get null coefficients.
    """
    design = f"struct(array({', '.join(terms)}) AS x, CAST({target} AS DOUBLE) AS v, month(ds) AS month)"
    gathered = rows.groupBy(*by).agg(
        F.collect_list(F.expr(f"if({usable}, {design}, NULL)")).alias("train"), *gather
    )
    solve = ridge_solver([BASE_RIDGE + r for r in ridge])
    return gathered.withColumn("coef", solve(F.flatten("train.x"), F.col("train.v")))
