"""License scan: independent hash functions, the same measure as the SQL, and matches where they are easily lost."""

import random

import pytest
from pyspark.sql import functions as F

from lunario.llm import licenses
from oracle import compare, connect


def words(n, seed):
    draw = random.Random(seed)
    return [f"w{draw.randrange(10**9)}" for _ in range(n)]


TEXTS = {n: " ".join(words(n, n)) for n in (5, 6, 8, 12, 20, 40, 90)}


def test_whole_templates_are_found_whatever_their_size_and_place(spark):
    """2,100 documents, each with one whole template at a place of its own."""
    draw = random.Random(1)
    rows = []
    for k in range(2100):
        size = sorted(TEXTS)[k % len(TEXTS)]
        before, after = (" ".join(words(draw.randrange(60), (k, s).__hash__())) for s in (1, 2))
        rows.append((k, f"{before} {TEXTS[size]} {after}", f"t{size}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, wanted string")
    found = licenses.scan(docs, {f"t{n}": t for n, t in TEXTS.items()})
    met = {(r.doc_id, r.license): r.containment for r in found.collect()}
    lost = [k for k, _, wanted in rows if met.get((k, wanted)) != 1.0]
    assert lost == []


def test_hash_functions_are_independent(spark):
    """The place of the least hash of 16 shingles is even, and two functions agree on it one time in 16."""
    size, draws = 16, 4000
    shingles = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.xxhash64(F.col("id"), i))
    least = [
        F.array_min(F.transform(shingles, lambda x, i: F.struct(F.xxhash64(F.lit(k), x), i.alias("i"))))["i"].alias(f"k{k}")
        for k in range(8)
    ]
    rows = [tuple(r) for r in spark.range(draws).select(*least).collect()]
    for k in range(8):
        counts = [sum(r[k] == i for r in rows) for i in range(size)]
        assert max(abs(c - draws / size) for c in counts) < 6 * (draws / size) ** 0.5
    agree = sum(a == b for r in rows for n, a in enumerate(r) for b in r[:n]) / (28 * draws)
    assert abs(agree - 1 / size) < 0.006


def test_same_measure_as_the_sql(spark, tmp_path):
    """Notices with words put in, left out and repeated, under null and repeated ids."""
    draw = random.Random(8)
    rows = []
    for k in range(400):
        text = licenses.TEMPLATES[sorted(licenses.TEMPLATES)[k % len(licenses.TEMPLATES)]].split()
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(text))
            text[at : at + draw.randrange(2)] = words(draw.randrange(3), draw.random())
        filler = [" ".join(words(draw.randrange(30), draw.random())) for _ in "ab"]
        rows.append((None if k % 17 == 0 else k // 2, f"{filler[0]} {' '.join(text)} {filler[1]} {' '.join(text[::1])}"))
    rows += rows[:5]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t" / "documents.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/t/documents.parquet/*.parquet'")
    problem, count = compare(spark, con, str(tmp_path / "t"), licenses.op2_minhash_license_scan, licenses.OP2_SQL)
    assert problem is None and count > 100


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), {"x": "four words only here"})
