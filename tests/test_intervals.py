"""Bounds of forecasts: quantiles of neighbouring steps, growth, and what lies past the window."""

import math

import pytest
from pyspark.sql import functions as F

from lunario.operators.intervals import with_bounds

POINTS = "array<struct<fold_id:int,step:int,ds:date,y:double,yhat:double>>"
AHEAD = "array<struct<ds:date,y:double,yhat:double>>"


def bounded(spark, gaps, horizon, **options):
    """Widths of ``horizon`` months; ``gaps``: (fold, step, error or None)."""
    validation = [(f, s, None, None if g is None else 100.0 + g, 100.0) for f, s, g in gaps]
    ahead = [(None, None, 10.0 * k) for k in range(horizon)]
    row = spark.createDataFrame([("a", validation, ahead)], f"series string, validation {POINTS}, forecast {AHEAD}")
    points = with_bounds(row, **options).select(F.inline("forecast")).collect()
    for p in points:
        assert p.lower is None or p.upper - p.yhat == pytest.approx(p.yhat - p.lower)
    return [None if p.upper is None else p.upper - p.yhat for p in points]


def plain(gaps, horizon, coverage=0.8, around=3):
    known = [(s, abs(g)) for _, s, g in gaps if g is not None]
    if not known:
        return [None] * horizon
    last, widths = max(s for s, _ in known), []
    for step in range(1, last + 1):
        pool = sorted([g for s, g in known if abs(s - step) <= around] or [g for _, g in known])
        width = pool[min(len(pool), math.ceil((len(pool) + 1) * coverage)) - 1]
        widths.append(max([width, *widths[-1:]]))
    middle = (last + 1) / 2
    square = sum((s + 1 - middle) ** 2 for s in range(last))
    rate = max(0.0, sum((s + 1 - middle) * w for s, w in enumerate(widths)) / square) if last > 1 else 0.0
    return [widths[h] if h < last else widths[-1] + rate * (h + 1 - last) for h in range(horizon)]


@pytest.mark.parametrize("folds,last", [(1, 1), (1, 12), (3, 12), (5, 36)])
def test_against_a_plain_version(spark, folds, last):
    gaps = [(f, s, math.sin(7 * f + s) * (3 + s)) for f in range(folds) for s in range(1, last + 1)]
    for case in (gaps, [(f, s, None if (f + s) % 4 == 0 else g) for f, s, g in gaps], [g for g in gaps if g[1] % 9 == 1]):
        for options in ({}, {"coverage": 0.5, "around": 0}):
            got, want = bounded(spark, case, last + 10, **options), plain(case, last + 10, **options)
            assert got == [None if w is None else pytest.approx(w) for w in want]
            assert None in got or got == sorted(got)


def test_without_errors_there_are_no_bounds(spark):
    assert bounded(spark, [], 3) == [None] * 3
    assert bounded(spark, [(0, 1, None), (0, 2, float("nan"))], 2) == [None] * 2
    assert bounded(spark, [(0, 1, 2.0)], 0) == []


def test_width_grows_past_the_window(spark):
    got = bounded(spark, [(f, s, float(s)) for f in range(4) for s in range(1, 13)], 36)
    assert got[35] > got[11] > got[0]
