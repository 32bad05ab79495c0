"""Divergence: a plain version on edge cases, the merge against whole vectors, and exact prices."""

import re
from collections import Counter

import numpy as np
import pytest

from lunario.llm import divergence as d
from oracle import connect
from llmdata import SF_DIR

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(rows, least, top):
    """The contract, term by term."""
    groups, used = {}, {}
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(lowered(text or ""))
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        used.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in used[lang].items() if n >= least]
        v = len(kept)

        def prices(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * v) for t in kept}

        whole = prices(sum(sources.values(), Counter()))
        priced = {s: prices(c) for s, c in sources.items()}
        for s, p in priced.items():
            pairs = [(o, sum(abs(p[t] - q[t]) for t in kept)) for o, q in priced.items() if o != s]
            terms = [(t, p[t] - whole[t]) for t in kept if sources[s][t] and p[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, f, k) for k, (i, f) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(1, 50), (2, 1), (30, 50)])
def test_edge_cases(spark, edge, least, top):
    from pyspark.sql import functions as F

    rows = edge.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("source")))
    rows = rows.union(edge).select("doc_id", "text", "lang", "source", "n")
    got = sorted(map(tuple, d.divergence(rows, least, top).collect()))
    assert got == plain([(r["lang"], r["source"], r["text"]) for r in rows.collect()], least, top)


def test_many_blocks_and_slices(spark, documents, monkeypatch):
    monkeypatch.setattr(d, "SLICE_TERMS", 200)
    monkeypatch.setattr(d, "BLOCK_GROUPS", 3)
    got = sorted(map(tuple, d.op12_pair_merge_divergence(spark, SF_DIR).collect()))
    assert got == sorted(connect(SF_DIR).execute(f"SELECT lang, source, part, item, value, rank FROM ({d.OP12_SQL})").fetchall())


def test_no_rows(spark, nothing):
    assert d.divergence(nothing).collect() == []


def test_merge_against_whole_vectors():
    rng = np.random.default_rng(2)
    for _ in range(60):
        size = int(rng.integers(1, 3000))
        sides = []
        for share in rng.random(2):
            count = np.where(rng.random(size) < share**3, rng.integers(1, 50, size), 0)
            sides.append((count, int(count.sum()) + 5 * size))
        (x, nx), (y, ny) = sides
        sparse = [(np.flatnonzero(c), c[c > 0], n) for c, n in sides]
        cost, terms = d.pair_cost(*sparse)
        either = (x > 0) | (y > 0)
        assert terms == either.sum()
        assert cost == np.abs(d.price(x, nx) - d.price(y, ny))[either].sum()
        assert d.pair_cost(*reversed(sparse)) == (cost, terms)


def test_galloping():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 10 ** rng.integers(1, 6), rng.integers(0, 4000))) for _ in "ab")
        i, j = d.galloping(a, b)
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def test_prices_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        total = int(rng.integers(1, 9 * 10**15))
        count = int(rng.integers(0, total))
        assert d.price(count, total) == 1 + 10**9 * (count + 5) // total
