"""Self-join of 64-bit codes within a Hamming distance, as a pair walk over a binary trie.

The trie is implicit: codes are sorted, so a node is a range of them and its two
children part where the next bit turns to one. Pairs of nodes go down together;
a pair whose paths differ in more bits than the budget is dropped with all below
it. Nodes of a few codes are compared directly. Everything is vectorised over
the frontier of node pairs, and the frontier is worked off in bounded pieces.
"""

import numpy as np

LEAF = 32
FRONTIER = 1 << 17
LEAF_PAIRS = 1 << 8
WAITING_LINKS = 1 << 18


def _parting(codes, low, high, depth):
    """Where in every range [low, high) the bit at ``depth`` (from the top) turns to one."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    below = np.uint64((1 << (63 - depth)) - 1)
    first_one = ((codes[low] | bit) & ~below)
    return np.clip(np.searchsorted(codes, first_one), low, high)


def _compared(codes, a, b, budget, same):
    """Index pairs within the budget among nodes of at most LEAF codes; a, b: (low, high)."""
    step = np.arange(LEAF)
    at_a, at_b = a[0][:, None] + step, b[0][:, None] + step
    last = len(codes) - 1
    left, right = codes[np.minimum(at_a, last)], codes[np.minimum(at_b, last)]
    near = np.bitwise_count(left[:, :, None] ^ right[:, None, :]) <= budget
    # links are rare: only hits are checked for having run past their node
    pair, cell = np.divmod(np.flatnonzero(near.ravel()), LEAF * LEAF)
    i, j = np.divmod(cell, LEAF)
    x, y = at_a[pair, i], at_b[pair, j]
    keep = (x < a[1][pair]) & (y < b[1][pair])
    if same:
        keep &= x != y
    return x[keep], y[keep]


def near_pairs(codes, split, budget):
    """Yield arrays of index pairs of codes within ``budget`` bits.

    ``codes``: sorted distinct codes, or two such runs that meet at ``split``; with
    ``split`` None a run is joined with itself, otherwise the first with the second.
    """
    same = split is None
    n = len(codes)
    if n == 0 or (not same and split in (0, n)):
        return
    one = np.array
    root = (one([0]), one([n if same else split]), one([0 if same else split]), one([n]), one([0]))
    runs = (codes, codes) if same else (codes[:split], codes[split:])
    shift = 0 if same else split
    stack = [(0, root)]
    while stack:
        depth, frontier = stack.pop()
        if len(frontier[0]) > FRONTIER:
            half = len(frontier[0]) // 2
            stack += [(depth, tuple(x[:half] for x in frontier)), (depth, tuple(x[half:] for x in frontier))]
            continue
        al, ah, bl, bh, bits = frontier
        small = (ah - al <= LEAF) & (bh - bl <= LEAF)
        if depth == 64:
            small[:] = True
        if small.any():
            leaf = [x[small] for x in (al, ah, bl, bh)]
            for at in range(0, len(leaf[0]), LEAF_PAIRS):
                part = [x[at : at + LEAF_PAIRS] for x in leaf]
                x, y = _compared(codes, part[:2], part[2:], budget, same)
                if len(x):
                    yield x, y
            al, ah, bl, bh, bits = (x[~small] for x in frontier)
        if not len(al):
            continue
        am = _parting(runs[0], al, ah, depth)
        bm = _parting(runs[1], bl - shift, bh - shift, depth) + shift
        own = (al == bl) if same else np.zeros(len(al), bool)
        children = [
            (al, am, bl, bm, bits, None),
            (am, ah, bm, bh, bits, None),
            (al, am, bm, bh, bits + 1, None),
            (am, ah, bl, bm, bits + 1, ~own),
        ]
        kept = []
        for a0, a1, b0, b1, spent, allowed in children:
            keep = (a0 < a1) & (b0 < b1) & (spent <= budget)
            if allowed is not None:
                keep &= allowed
            kept.append([x[keep] for x in (a0, a1, b0, b1, spent)])
        joined = tuple(np.concatenate(x) for x in zip(*kept))
        if len(joined[0]):
            stack.append((depth + 1, joined))


def join_roots(root, x, y):
    """Merge the classes of x[k] and y[k] for all k; ``root`` points at each class's smallest index."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            higher = root[root]
            if np.array_equal(higher, root):
                break
            root[:] = higher


def class_roots(codes, split, budget):
    """For every code the index of the smallest code that a chain of links reaches here."""
    root = np.arange(len(codes))
    waiting, count = [], 0
    for x, y in near_pairs(codes, split, budget):
        apart = root[x] != root[y]
        if apart.any():
            waiting.append((x[apart], y[apart]))
            count += int(apart.sum())
        if count > WAITING_LINKS:
            join_roots(root, *map(np.concatenate, zip(*waiting)))
            waiting, count = [], 0
    if waiting:
        join_roots(root, *map(np.concatenate, zip(*waiting)))
    return root
