"""Vector codes: exact against plain rounds over all distances, with the bounds at work."""

import hashlib
import math

import numpy as np
import pytest

from lunario.llm import vector_codes as v


def plain(rows, parts=4, entries=256, rounds=4):
    """All distances in every round, in Python integers where they could be large."""
    held = [(i, [min(max(math.floor(1024 * x), -v.LIMIT), v.LIMIT) for x in e], label) for i, e, label in rows]
    held.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(held[0][1])
    held = [r for r in held if len(r[1]) == size]
    width = -(-size // parts)
    x = np.array([r[1] + [0] * (width * parts - size) for r in held], object).reshape(len(held), parts, width)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        own, error = np.zeros((len(held), parts), int), [0] * len(held)
        for p in range(parts):
            for row in range(len(held)):
                gaps = ((books[p] - x[row, p]) ** 2).sum(1).tolist()
                own[row, p] = min(range(len(gaps)), key=lambda k: (gaps[k], k))
                error[row] += gaps[own[row, p]]
            if turn < rounds:
                for e in range(books.shape[1]):
                    mine = x[own[:, p] == e, p]
                    if len(mine):
                        books[p, e] = [sum(c) // len(mine) for c in mine.T.tolist()]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = ["".join(f"{c:02x}" for c in row) for row in own.tolist()]
    return sorted((str(r[0]), c, e) for r, c, e in zip(held, codes, error)), digest


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, own string")


def same(spark, rows, kind="float", **options):
    usable = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    if kind == "float":
        usable = [(i, [float(np.float32(c)) for c in e], label) for i, e, label in usable]
    made = v.vector_codes(frame(spark, rows, kind), **options)
    got = sorted((str(r["vec_id"]), r["code"], r["error"]) for r in made.rows.collect())
    assert (got, made.digest()) == plain(usable, **{k: o for k, o in options.items() if k != "listed"})


@pytest.mark.parametrize("listed", [1, 5, 24])
def test_against_plain_rounds(spark, listed):
    rng = np.random.default_rng(listed)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(k, (centres[k % 12] + rng.normal(0, 0.3, 8)).tolist(), k % 3) for k in range(400)]
    same(spark, rows, entries=40, listed=listed)


def test_ties_copies_and_small_books(spark):
    rng = np.random.default_rng(9)
    grid = [(k, rng.integers(-2, 3, 8).astype(float).tolist(), None) for k in range(300)]
    same(spark, grid, entries=30, listed=6)
    same(spark, [(k, [1.0, 2.0, 3.0, 4.0], 1) for k in range(40)])
    same(spark, grid[:3])


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (5, [1.0, 2.0, 3.0, 4.0, -5.0], 1), (2, [0.1] * 5, None), (None, [0.5] * 5, None),
        (7, None, 1), (8, [nan] * 5, 1), (9, [1.0, inf, 1.0, 1.0, 1.0], 1), (10, [1.0, None, 1.0, 1.0, 1.0], 1),
        (11, [1e30, -1e30, 0.0, 1.0, 2.0], 2), (12, [1.0, 2.0], 2), (12, [], 2), (2, [0.1] * 5, None),
    ]
    same(spark, rows)
    same(spark, rows, "double", entries=4)


def test_no_rows(spark, tmp_path):
    for name, rows in (("none", []), ("null", [(1, None, 1)])):
        frame(spark, rows).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        found = v.op13_adaptive_bound_codes(spark, f"{tmp_path}/{name}")
        assert found.collect() == []
        assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_bounds_spare_distances():
    """On settled clusters most parts keep their entry without another distance."""
    rng = np.random.default_rng(0)
    entries = rng.integers(-5000, 5000, (1, 64, 16))
    rows = entries[0, rng.integers(0, 64, 3000)] + rng.integers(-300, 300, (3000, 16))
    first = v.Codebook(entries)
    own, _, listed, bounds = v._full(first, 0, rows, 8)
    moved = v.Codebook(entries + rng.integers(-40, 40, entries.shape), entries)
    again = v._bounded(moved, 0, rows, own, listed, bounds)
    whole = v._full(moved, 0, rows, 8)
    assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()
    assert (again[4] == 0).mean() > 0.95
