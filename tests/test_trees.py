"""Boosted trees against a plain booster that grows one tree at a time by recursion."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lunario.fixed import TREE_GRID
from lunario.operators.models import records
from lunario.operators.models.trees import LEAST_GAIN, choice, column_choices, fitted, panel_trees
from test_models import held_out
from test_panel import months

NONE = {"reg_lambda": 0.0, "reg_alpha": 0.0, "gamma": 0.0}


def soft(total, alpha):
    return math.copysign(max(abs(total) - alpha, 0.0), total)


def plain(months_of, years, targets, setting, counts, penalties):
    share, rate, depth = setting
    alpha, gamma, damping = penalties["reg_alpha"], penalties["gamma"], penalties["reg_lambda"]
    cells = [(m, (m - 1) // 3 + 1, y) for m, y in zip(months_of, years)]
    train = [k for k, t in enumerate(targets) if not math.isnan(t)]
    bounds = [sorted({cells[k][f] for k in train})[1:] for f in range(3)]
    predicted = [sum(targets[k] for k in train) / len(train)] * len(cells)
    out = []

    def score(total, n):
        return soft(total, alpha) ** 2 / (n + damping)

    def grow(inside, left, features, added):
        own = [k for k in inside if k in known]
        total = sum(predicted[k] - targets[k] for k in own)
        best = (LEAST_GAIN, None)
        if left:
            for f in features:
                for v in bounds[f]:
                    low = [k for k in own if cells[k][f] < v]
                    if 0 < len(low) < len(own):
                        g = sum(predicted[k] - targets[k] for k in low)
                        gain = score(g, len(low)) + score(total - g, len(own) - len(low)) - score(total, len(own))
                        # sums in another order: a gain must be better by more than that
                        if gain > best[0] * (1 + 1e-9) and gain >= gamma:
                            best = (gain, (f, v))
        if best[1] is None:
            for k in inside:
                added[k] = -rate * soft(total, alpha) / (len(own) + damping)
            return
        f, v = best[1]
        grow([k for k in inside if cells[k][f] < v], left - 1, features, added)
        grow([k for k in inside if cells[k][f] >= v], left - 1, features, added)

    known = set(train)
    for tree in range(max(counts)):
        choices, added = column_choices(share), [0.0] * len(cells)
        grow(range(len(cells)), depth, choices[choice(tree, len(choices))], added)
        predicted = [p + a for p, a in zip(predicted, added)]
        if tree + 1 in counts:
            out.append(predicted)
    return out


@pytest.mark.parametrize("penalties", [NONE, {"reg_lambda": 1.5, "reg_alpha": 20.0, "gamma": 300.0}])
def test_fits_of_a_batch_against_single_ones(penalties):
    rng = np.random.default_rng(7)
    fits = []
    for n, future in ((40, 5), (17, 30), (3, 2), (60, 0)):
        t = np.arange(n + future) + int(rng.integers(0, 12))
        target = 100 + 40 * np.cos(t) + rng.normal(0, 30, n + future)
        target[rng.random(n + future) < 0.15] = np.nan
        target[n:] = np.nan
        fits.append((t % 12 + 1, 1999 + t // 12, target))
    fits[2][2][0] = 5.0  # a row to train on in any case
    settings = [(0.4, 0.3, 2), (0.7, 0.5, 5), (1.0, 0.1, 3), (1.0, 0.5, 10)]
    counts = [1, 4, 9]
    for shift in range(4):
        turned = settings[shift:] + settings[:shift]
        got = fitted(*map(list, zip(*fits)), turned, counts, penalties)
        for k, (m, y, target) in enumerate(fits):
            want = plain(m.tolist(), y.tolist(), target.tolist(), turned[k], counts, penalties)
            assert got[k, :, : len(m)] == pytest.approx(np.array(want), rel=1e-9)


def test_settled_fits_are_exact():
    """Trees that are left out once nothing changes would all have been zero."""
    t = np.arange(36)
    target = 1000 + 300 * np.sin(t) + 5.0 * t
    penalties = {"reg_lambda": 0.0, "reg_alpha": 150.0, "gamma": 100.0}
    counts = [10, 60, 200]
    for setting in ((0.4, 0.5, 3), (1.0, 0.5, 2)):
        got = fitted([t % 12 + 1], [2000 + t // 12], [target], [setting], counts, penalties)
        want = plain((t % 12 + 1).tolist(), (2000 + t // 12).tolist(), target.tolist(), setting, counts, penalties)
        assert got[0] == pytest.approx(np.array(want), rel=1e-9)


def test_a_fit_without_training_rows():
    t = np.arange(5)
    nothing = np.full(5, np.nan)
    got = fitted([t + 1, t + 1], [t * 0 + 2000] * 2, [nothing, t * 1.0], [(1.0, 0.5, 3)] * 2, [2], NONE)
    assert np.isnan(got[0]).all() and not np.isnan(got[1]).any()


def test_sets_are_numbered_as_in_the_grid(spark):
    """Whatever the order of tree counts, a set's record is that of its own numbers."""
    rows = held_out(months(spark, 48, value="100D + 30D * cos(i) + i"))
    sets = {"colsample_bytree": [1.0, 0.4], "learning_rate": [0.5], "max_depth": [2], "n_estimators": [7, 1, 3]}
    many = {(r.fold_id, r.param_id): r.predictions for r in panel_trees(rows, sets, penalties=NONE).collect()}
    assert len(many) == 2 * 6
    number = 0
    for share in sets["colsample_bytree"]:
        for count in sets["n_estimators"]:
            one = {k: [v] for k, v in zip(sorted(sets), (share, 0.5, 2, count))}
            for r in panel_trees(rows, one, penalties=NONE).collect():
                assert r.predictions == many[r.fold_id, number]
            number += 1


def test_the_whole_grid_and_a_series_without_values(spark):
    season = "1000000D * (1D + 0.4D * cos(0.5235987755982988D * (i % 12)))"
    rows = months(spark, 60, series="a", value=season).union(months(spark, 60, series="b", value="cast(null as double)"))
    found = panel_trees(held_out(rows), TREE_GRID)
    assert found.count() == 2 * 2 * 81
    chosen = {r.series: r for r in records.choose(found).collect()}
    assert chosen["a"].mape < 1 and chosen["a"].status == "tuned"
    assert chosen["b"].mape is None and all(p.yhat is None for p in chosen["b"].forecast)
    assert found.where("series = 'a'").where(F.exists("predictions", lambda p: p["yhat"].isNull())).count() == 0


def test_series_do_not_see_each_other(spark):
    """Folds of series that end at different months share a number and nothing else."""
    a, b = months(spark, 40, value="50D + i"), months(spark, 70, series="b", value="900D - i")
    sets = {k: [v] for k, v in zip(sorted(TREE_GRID), (1.0, 0.5, 3, 5))}
    both = {r.series: r.forecast for r in records.choose(panel_trees(held_out(a.union(b)), sets, penalties=NONE)).collect()}
    alone = records.choose(panel_trees(held_out(a), sets, penalties=NONE)).first()
    assert both["a"] == alone.forecast
