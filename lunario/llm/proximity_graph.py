"""Robust-pruned directed graph over the unit vectors of one shard.

Nodes are inserted in batches. A greedy search from the middle of the shard
proposes neighbours for each; relaxed distance pruning keeps a candidate only
if no neighbour kept before is closer to it by the factor ``RELAXED``, which
leaves edges in diverse directions; the reverse edges follow, and a node with
too many is pruned again. Searches of many queries go in step: each round opens
every query's nearest unopened node.
"""

import numpy as np

DEGREE = 32
BUILD_BEAM = 48
RELAXED = 1.2
BATCH = 512


def _near(vectors, points, ids):
    """Squared distances between points (b, d) and vectors[ids] (b, k), for unit vectors."""
    return 2.0 - 2.0 * np.matmul(vectors[ids], points[:, :, None])[:, :, 0]


def beam_search(vectors, edges, entry, points, beam):
    """(ids, distances) of the ``beam`` nearest nodes met per point, nearest first; -1 where there are fewer.

    ``edges``: (n, degree) with -1 for none; ``entry``: ids to start from.
    """
    b, n = len(points), len(vectors)
    ids = np.full((b, beam), -1, np.int64)
    far = np.full((b, beam), np.inf, np.float32)
    fresh = np.zeros((b, beam), bool)
    first = entry[:beam]
    ids[:, : len(first)] = first
    far[:, : len(first)] = _near(vectors, points, np.broadcast_to(first, (b, len(first))))
    fresh[:, : len(first)] = True
    seen = np.zeros((b, n), bool)
    seen[:, first] = True
    live = np.arange(b)
    while len(live):
        waiting = np.where(fresh[live], far[live], np.inf)
        pick = waiting.argmin(1)
        open_ones = np.isfinite(waiting[np.arange(len(live)), pick])
        live, pick = live[open_ones], pick[open_ones]
        if not len(live):
            break
        fresh[live, pick] = False
        met = edges[ids[live, pick]]
        new = (met >= 0) & ~seen[live[:, None], met]
        row, column = np.nonzero(new)
        seen[live[row], met[row, column]] = True
        reach = _near(vectors, points[live], np.maximum(met, 0))
        reach[~new] = np.inf
        all_ids = np.concatenate([ids[live], met], 1)
        all_far = np.concatenate([far[live], reach], 1)
        all_fresh = np.concatenate([fresh[live], new], 1)
        order = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, order, 1)
        far[live] = np.take_along_axis(all_far, order, 1)
        fresh[live] = np.take_along_axis(all_fresh, order, 1) & np.isfinite(far[live])
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    ids[~np.isfinite(far)] = -1
    return ids, far


def robust_pruned(vectors, nodes, candidates):
    """At most DEGREE diverse neighbours (b, DEGREE) of each node among its candidates (b, c; -1 for none)."""
    b, c = candidates.shape
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    far = _near(vectors, vectors[nodes], np.maximum(candidates, 0))
    far[candidates < 0] = np.inf
    among = vectors[np.maximum(candidates, 0)]
    between = 2.0 - 2.0 * np.matmul(among, among.transpose(0, 2, 1))
    kept = np.full((b, DEGREE), -1, np.int64)
    rows = np.arange(b)
    alive = far.copy()
    for k in range(DEGREE):
        nearest = alive.argmin(1)
        some = np.isfinite(alive[rows, nearest])
        if not some.any():
            break
        kept[some, k] = candidates[rows[some], nearest[some]]
        # squared distances, so the factor counts twice
        covered = RELAXED * RELAXED * between[rows, nearest] <= far
        alive[covered & some[:, None]] = np.inf
        alive[rows, nearest] = np.inf
    return kept


def entry_points(vectors):
    """The node nearest to the mean, and some spread over the shard."""
    middle = int(np.argmax(vectors @ vectors.mean(0)))
    spread = np.linspace(0, len(vectors) - 1, min(7, len(vectors))).astype(np.int64)
    return np.array(list(dict.fromkeys([middle, *spread.tolist()])), np.int64)


def built(vectors, seed=0):
    """Edges (n, DEGREE) of the graph over unit vectors (n, d), -1 for none."""
    n = len(vectors)
    edges = np.full((n, DEGREE), -1, np.int64)
    entry = entry_points(vectors)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([entry, order[~np.isin(order, entry)]])
    edges[entry] = robust_pruned(vectors, entry, np.broadcast_to(entry, (len(entry), len(entry))))
    at, size = len(entry), 16
    while at < n:
        nodes = order[at : at + size]
        found, _ = beam_search(vectors, edges, entry, vectors[nodes], BUILD_BEAM)
        # nodes of one batch do not see each other through the graph yet
        peers = np.argpartition(-(vectors[nodes] @ vectors[nodes].T), min(9, len(nodes) - 1), axis=1)[:, :9]
        edges[nodes] = robust_pruned(vectors, nodes, np.concatenate([found, nodes[peers]], 1))
        _add_reverse(vectors, edges, nodes)
        at += size
        size = min(BATCH, 2 * size)
    return edges


def _add_reverse(vectors, edges, nodes):
    source = np.repeat(nodes, DEGREE)
    target = edges[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    touched, first, count = np.unique(target, return_index=True, return_counts=True)
    width = int(count.max()) if len(count) else 0
    # reverse edges of a popular node come in several rounds, so that no round is wide
    for low in range(0, width, DEGREE):
        some = count > low
        ids = touched[some]
        take = np.minimum(count[some] - low, DEGREE)
        slots = np.arange(DEGREE) < take[:, None]
        more = np.where(slots, source[np.minimum(first[some][:, None] + low + np.arange(DEGREE), len(source) - 1)], -1)
        for at in range(0, len(ids), BATCH):
            part = slice(at, at + BATCH)
            joined = np.concatenate([edges[ids[part]], more[part]], 1)
            repeated = (more[part][:, :, None] == edges[ids[part]][:, None, :]).any(2)
            joined[:, DEGREE:][repeated] = -1
            full = (joined >= 0).sum(1) > DEGREE
            kept = np.sort(joined, 1)[:, ::-1][:, :DEGREE]
            if full.any():
                kept[full] = robust_pruned(vectors, ids[part][full], joined[full])
            edges[ids[part]] = kept
