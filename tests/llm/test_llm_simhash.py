"""SimHash against plain fingerprints and all pairs; the trie walk against all pairs; components against a search."""

import re

import numpy as np
import xxhash

from lunario.llm.components import components
from lunario.llm.simhash import fingerprint, near_duplicates, op10_simhash_near_dedup
from lunario.llm.trie_join import class_roots, near_pairs
from llmdata import SF_DIR


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_query_equals_all_pairs(spark, texts):
    codes = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(codes)
    pairs = [(a, b) for a in ids for b in ids if a < b and (codes[a] ^ codes[b]).bit_count() <= 4]
    of = classes(pairs, ids)
    expected = {(i, f"{codes[i]:016x}", of[i]) for i in ids}
    assert {tuple(r) for r in op10_simhash_near_dedup(spark, SF_DIR).collect()} == expected


def test_small_shards_change_nothing(documents):
    one = {tuple(r) for r in near_duplicates(documents).select("doc_id", "component_id").collect()}
    many = near_duplicates(documents, shard_codes=40).select("doc_id", "component_id")
    assert {tuple(r) for r in many.collect()} == one


def test_short_texts():
    assert fingerprint(b"") == fingerprint(b" \n\t") == 0
    assert fingerprint("Ärger B".encode()) == xxhash.xxh64("Ärger b".encode(), seed=42).intdigest()


def test_trie_walk_finds_exactly_the_near_pairs():
    draw = np.random.default_rng(5)
    codes = draw.integers(0, 1 << 63, 400, dtype=np.uint64) * 2
    near = np.repeat(codes[:60], 20)
    for k in range(len(near)):
        for b in draw.choice(64, draw.integers(0, 6), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    codes = np.unique(np.concatenate([codes, near, [np.uint64(0), np.uint64(2**64 - 1)]]))
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    expected = {(i, j) for i, j in zip(*np.nonzero(apart <= 4)) if i < j}
    found = {(min(a, b), max(a, b)) for x, y in near_pairs(codes, None, 4) for a, b in zip(x.tolist(), y.tolist())}
    assert found == {(int(i), int(j)) for i, j in expected}
    left, right = codes[::2], codes[1::2]
    both = np.concatenate([left, right])
    found = {(int(both[a]), int(both[b])) for x, y in near_pairs(both, len(left), 4) for a, b in zip(x, y)}
    even = set(left.tolist())
    crossing = [(int(codes[i]), int(codes[j])) for i, j in expected]
    assert found == {(a, b) if a in even else (b, a) for a, b in crossing if (a in even) != (b in even)}
    of = classes(expected, range(len(codes)))
    assert class_roots(codes, None, 4).tolist() == [of[i] for i in range(len(codes))]


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 560)]
    rows = components(spark.createDataFrame([*chain, *star, (7, 7), (9, 8), (8, 9)], "a long, b long")).collect()
    expected = {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 560)} | {8: 8, 9: 8}
    assert dict(map(tuple, rows)) == expected
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
