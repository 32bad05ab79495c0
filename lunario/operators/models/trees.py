"""Boosted trees on calendar features, one fit per series, fold and setting.

The features are month, quarter and year, so a fit's rows are cells of a small
month x year table and a split is a cut between two months, quarters or years.
Every (series, fold) becomes one row that holds its months as arrays; each row is
repeated once per setting (column share, rate, depth), spread by these keys, and
fitted a batch at a time. The trees of all fits of a batch grow in step: per level,
the gradient and curvature sums of all open nodes by feature value come from one
counting pass, their running totals give the gain of every cut, and the best cut
moves the cells, those to be predicted included, to the child nodes. Predictions
are therefore known after every tree, and one fit serves all asked tree counts.

A leaf's weight is -T(G) / (H + lambda) with T the soft threshold by alpha, a
cut's gain T(GL)^2/(HL + lambda) + T(GR)^2/(HR + lambda) - T(G)^2/(H + lambda); a
cut needs a gain of at least gamma and a training row on either side. A fit whose
trees have stopped changing anything, for every choice of columns, is settled: its
further trees would all be zero and are not grown.

Columns are sampled per tree, max(1, floor(share * 3)) of them, by a multiplicative
hash of the tree's number, so that every run draws the same.
"""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lunario.fixed import TREE_GRID, TREE_PENALTIES
from lunario.functions.calendar import calendar_features
from lunario.operators.grid import grid_rows
from lunario.operators.models.records import by_series, with_errors

FEATURES = ["month", "quarter", "year"]
BATCH = 96
LEAST_GAIN = 1e-6  # a cut must gain something even where gamma is 0


def column_choices(share):
    """The column subsets that a tree may be given, in the order that ``choice`` numbers them."""
    size = max(1, int(share * len(FEATURES)))
    return list(itertools.combinations(range(len(FEATURES)), size))


def choice(tree, choices):
    """Which of ``choices`` subsets the tree of this number (from 0) is given."""
    return (tree * 2654435761 % 4294967296 >> 16) % choices


def tree_cells(rows, keys=("series",)):
    """One row per series and fold: its months with features, whether they train, and the target.

    The target is null where it is not to be learnt; later months are those to
    predict. Their number is bounded by the months of a series and its horizon.
    """
    train = (F.col("part") == "train") & F.col("y").isNotNull()
    later = F.col("part") != "train"
    cell = F.struct(
        "ds", *FEATURES, F.when(later, F.col("y")).alias("y"), F.when(train, F.col("y")).alias("target"), later.alias("later")
    )
    used = calendar_features(rows).where(train | later)
    return used.groupBy(*keys, "fold_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


class _Batch:
    """Fits that grow in step: arrays of fits x cells, filled up with cells of no weight."""

    def __init__(self, months, years, targets, settings):
        fits = len(months)
        shape = (fits, max(map(len, months)))
        month, year = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.weight, self.target = np.zeros(shape), np.zeros(shape)
        for k, (m, y, of_fit) in enumerate(zip(months, years, targets)):
            of_fit = np.asarray(of_fit, float)
            month[k, : len(m)], year[k, : len(m)] = np.asarray(m) - 1, np.asarray(y) - np.min(y)
            self.weight[k, : len(m)], self.target[k, : len(m)] = ~np.isnan(of_fit), np.nan_to_num(of_fit)
        self.value = {"month": month, "year": year}
        rows = self.weight.sum(1)
        mean = np.divide((self.weight * self.target).sum(1), rows, out=np.full(len(rows), np.nan), where=rows > 0)
        self.predicted = np.repeat(mean[:, None], shape[1], 1)
        self.share, self.rate, self.depth = (np.array(s) for s in zip(*settings))
        self.at, self.quiet = np.arange(fits), np.zeros(fits, np.int64)
        # a cut lies in front of a value that training rows have
        self.years = int(year.max()) + 1
        fit = np.arange(fits)[:, None]
        by_month = np.bincount((fit * 12 + month).ravel(), self.weight.ravel(), fits * 12).reshape(fits, 12) > 0
        by_year = np.bincount((fit * self.years + year).ravel(), self.weight.ravel(), fits * self.years) > 0
        by_quarter = by_month.reshape(fits, 4, 3).any(2)
        self.cuts = np.concatenate([by_month[:, 1:], by_quarter[:, 1:], by_year.reshape(fits, -1)[:, 1:]], 1)

    def keep(self, some):
        for name in ("weight", "target", "predicted", "share", "rate", "depth", "at", "quiet", "cuts"):
            setattr(self, name, getattr(self, name)[some])
        self.value = {k: v[some] for k, v in self.value.items()}

    def allowed(self, tree):
        """Which cuts each fit's column subset leaves."""
        sizes = (11, 3, self.years - 1)
        by_share = {}
        for share in np.unique(self.share):
            choices = column_choices(share)
            taken = choices[choice(tree, len(choices))]
            by_share[share] = np.concatenate([np.full(s, f in taken) for f, s in enumerate(sizes)])
        return self.cuts & np.stack([by_share[s] for s in self.share])


def _soft(total, alpha):
    return total - np.clip(total, -alpha, alpha)


def _grow(batch, tree, penalties):
    """One tree for every fit of the batch: what it adds to each cell."""
    alpha, gamma, damping = (penalties[k] for k in ("reg_alpha", "gamma", "reg_lambda"))
    gradient = batch.weight * (batch.predicted - batch.target)
    allowed = batch.allowed(tree)
    fits, n = gradient.shape
    added = np.zeros((fits, n))
    # open nodes, each of one fit; cells carry the number of their open node
    node_fit = np.arange(fits)
    cell = np.arange(fits * n)
    node = np.repeat(np.arange(fits), n)
    month, year = batch.value["month"].ravel(), batch.value["year"].ravel()
    g, h, out = gradient.ravel(), batch.weight.ravel(), added.ravel()
    columns = 12 + batch.years
    for level in range(int(batch.depth.max()) + 1):
        total_g, total_h = (np.bincount(node, w[cell], len(node_fit)) for w in (g, h))
        soft = _soft(total_g, alpha)
        # a node of one row, or as deep as it may be, is a leaf
        grows = (total_h >= 2) & (level < batch.depth[node_fit])
        if grows.any():
            open_nodes = np.flatnonzero(grows)
            number = np.cumsum(grows) - 1
            inside = np.flatnonzero(grows[node])
            at, of = cell[inside], number[node[inside]] * columns
            place = np.concatenate([of + month[at], of + 12 + year[at]])
            sums = []
            for w in (g, h):
                by_value = np.bincount(place, np.tile(w[at], 2), len(open_nodes) * columns).reshape(-1, columns)
                by_month, by_year = by_value[:, :12].cumsum(1), by_value[:, 12:].cumsum(1)
                sums.append(np.concatenate([by_month[:, :-1], by_month[:, 2:-1:3], by_year[:, :-1]], 1))
            left_g, left_h = sums
            right_g, right_h = total_g[open_nodes, None] - left_g, total_h[open_nodes, None] - left_h
            usable = allowed[node_fit[open_nodes]] & (left_h >= 1) & (right_h >= 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = _soft(left_g, alpha) ** 2 / (left_h + damping) + _soft(right_g, alpha) ** 2 / (right_h + damping)
            gain[~usable] = -np.inf
            best = gain.argmax(1)
            most = gain[np.arange(len(best)), best] - soft[open_nodes] ** 2 / (total_h[open_nodes] + damping)
            split = (most > LEAST_GAIN) & (most >= gamma)
            grows[open_nodes] = split
            cuts = np.zeros(len(node_fit), np.int64)
            cuts[open_nodes] = best
        ended = ~grows[node]
        if ended.any():
            weight = -soft / np.maximum(total_h + damping, 1e-300)
            out[cell[ended]] = weight[node[ended]]
            cell, node = cell[~ended], node[~ended]
        if not len(cell):
            break
        # months, quarters and years as one kind of cut: a value that must not exceed a bound
        cut = cuts[node]
        by_year = cut >= 14
        bound = np.where(cut < 11, cut, np.where(by_year, cut - 14, (cut - 11) * 3 + 2))
        right = np.where(by_year, year[cell], month[cell]) > bound
        node = 2 * (np.cumsum(grows) - 1)[node] + right
        node_fit = np.repeat(node_fit[grows], 2)
    return added * batch.rate[:, None]


def fitted(months, years, targets, settings, counts, penalties):
    """Predictions of all cells of each fit after each of the rising tree ``counts``: fits x counts x cells.

    ``months``, ``years`` and ``targets`` hold an array for each fit, NaN where a
    cell does not train; ``settings`` its column share, rate and depth.
    """
    batch = _Batch(months, years, targets, settings)
    out = np.repeat(batch.predicted[:, None, :], len(counts), 1)
    batch.keep(batch.weight.any(1))  # a fit without training rows predicts nothing
    choices = np.array([len(column_choices(s)) for s in batch.share], np.int64)
    for tree in range(max(counts)):
        if not len(batch.at):
            break
        added = _grow(batch, tree, penalties)
        batch.predicted = batch.predicted + added
        drawn = np.array([choice(tree, c) for c in choices.tolist()], np.int64)
        batch.quiet = np.where(added.any(1), 0, batch.quiet | (1 << drawn))
        settled = batch.quiet == (1 << choices) - 1
        for place, count in enumerate(counts):
            known = settled if count > tree + 1 else np.full(len(settled), count == tree + 1)
            out[batch.at[known], place] = batch.predicted[known]
        if settled.any():
            batch.keep(~settled)
            choices = choices[~settled]
    return out


def _fit_batches(keys, sets, counts, penalties):
    """Pandas batches of (keys, fold_id, setting, the months of a fold) to predictions by tree count."""

    def run(batches):
        for whole in batches:
            for low in range(0, len(whole), BATCH):
                part = whole.iloc[low : low + BATCH]
                of_sets = [sets[k] for k in part["setting"]]
                values = fitted(list(part["months"]), list(part["years"]), list(part["targets"]), of_sets, counts, penalties)
                rows = []
                for row, of_fit in zip(part.itertuples(index=False), values):
                    later = np.flatnonzero(row.later)
                    for place in range(len(counts)):
                        yhat = [None if np.isnan(v) else v for v in of_fit[place, later].tolist()]
                        rows.append((*(getattr(row, k) for k in keys), row.fold_id, row.setting * len(counts) + place, yhat))
                yield pd.DataFrame(rows, columns=[*keys, "fold_id", "param_id", "yhat"])

    return run


def panel_trees(rows, grid=TREE_GRID, keys=("series",), penalties=TREE_PENALTIES):
    """Fold records of boosted trees: every set of ``grid`` for every series and fold.

    A fold without training rows has null predictions. The number of trees varies
    fastest among the sets, so a setting's sets follow each other.
    """
    names, sets = grid_rows(grid)
    assert names == ["colsample_bytree", "learning_rate", "max_depth", "n_estimators"], names
    settings = list(dict.fromkeys(s[:3] for s in sets))
    counts = list(dict.fromkeys(s[3] for s in sets))
    rising = sorted(counts)
    number = F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))).alias("setting")
    by = [*keys, "fold_id"]
    gathered = tree_cells(rows, keys)
    fields = {"months": "month", "years": "year", "targets": "target", "later": "later"}
    arrays = [F.col("cells")[field].alias(name) for name, field in fields.items()]
    # a stated number of tasks: few bytes are many fits, and must not be coalesced into one task
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = gathered.select(*by, *arrays, number).repartition(tasks, *by, "setting")
    kinds = {f.name: f.dataType.simpleString() for f in gathered.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", param_id int, yhat array<double>"
    made = spread.mapInPandas(_fit_batches(keys, settings, rising, penalties), schema)
    # sets are numbered in the order of the grid, counts were fitted in rising order
    place = F.element_at(F.array(*[F.lit(counts.index(c)) for c in rising]), F.col("param_id") % len(counts) + 1)
    made = made.withColumn("param_id", (F.floor(F.col("param_id") / len(counts)) * len(counts) + place).cast("int"))
    months = gathered.select(*by, F.filter("cells", lambda c: c["later"]).alias("steps"))
    joined = made.join(months, by)
    points = F.zip_with(
        "steps", "yhat", lambda c, v: F.struct(c["ds"].alias("ds"), c["y"].alias("y"), v.alias("yhat"))
    )
    return by_series(with_errors(joined.withColumn("predictions", points)), keys)
