"""Source divergence audit: how far the word use of sources of one language lies apart.

Tasks count terms of whole texts by (lang, source) first, in memory of a bounded
size; one shuffle by (lang, term) brings the counts together and decides which
terms enough documents use. The kept terms of a language are dealt to slices of
about ``SLICE_TERMS`` by a hash and numbered within their slice, so a group (a
language and source) is, for each slice, a pair of arrays: sorted term numbers
and their counts.

Groups of a language are dealt to blocks of about ``BLOCK_GROUPS`` by a hash. A
task co-groups the arrays of two blocks for one slice and prices every unordered
pair of groups in them by a sparse merge: a galloping intersection finds the
terms of both, which are priced at both counts; terms of one side are priced
against the other side's price of an absent term, both ways; how many terms
neither has is known from the size of the union. The sums of the slices are added,
and each unordered pair becomes a row for either side.

All arithmetic is in integers. The share 1e9 * (count + 5) / (N + 5 * V) is
divided in three steps of a thousand, exact while N + 5 * V is below 9e15.

Defined results: null text, lang and source are empty strings, as any other
value of theirs. A document without terms, of empty text or null, still makes its
group occur. Very long texts are counted whole. Repeated rows are documents of
their own. Ties in rank go by the item's UTF-8 bytes. A language whose terms are
all dropped has V = 0: its pairs have value 0 and it has no terms. A language
with one source has no pairs. An empty table gives no rows. Other columns are not
looked at.
"""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lunario.llm.common import binary_values, written

LEAST_DOCUMENTS = 30
ADDED = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
SLICE_TERMS = 4096
BLOCK_GROUPS = 16
COUNTED_AT_ONCE = 250_000

# letters and everything beyond ASCII make terms; only A-Z are lower-cased
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n), partial counts of the tasks; every group has a row with a null term too."""

    def count(batches):
        groups, held = {}, 0
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in (0, 1))
            for lang, source, text in zip(*columns, binary_values(batch.column(2))):
                seen, used = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(seen)
                terms = text.translate(_TERM_BYTES).split()
                seen.update(terms)
                used.update(set(terms))
                held += len(seen) - before
                if held > COUNTED_AT_ONCE:
                    yield from _counted(groups)
                    groups, held = {}, 0
        yield from _counted(groups)

    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        "text",
    )
    return texts.mapInArrow(count, "lang string, source string, term binary, docs long, n long")


def _counted(groups):
    for (lang, source), (seen, used) in groups.items():
        terms = [None, *seen]
        size = len(terms)
        columns = [
            pa.array([lang] * size, pa.string()),
            pa.array([source] * size, pa.string()),
            pa.array(terms, pa.binary()),
            pa.array([0, *map(used.__getitem__, seen)], pa.int64()),
            pa.array([0, *seen.values()], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "docs", "n"])


def kept_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the kept terms, and every group with a null term; written.

    ``first`` marks one row of every (lang, term).
    """
    dealt = term_counts(docs).repartition("lang", "term")
    summed = dealt.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    of_term = Window.partitionBy("lang", "term")
    joined = summed.withColumns(
        {
            "lang_docs": F.sum("docs").over(of_term),
            "lang_n": F.sum("n").over(of_term),
            "first": F.row_number().over(of_term.orderBy("source")) == 1,
        }
    )
    kept = joined.where(F.col("term").isNull() | (F.col("lang_docs") >= least_documents))
    return written(kept.select("lang", "source", "term", "n", "lang_n", "first"), "kept-counts")


def price(count, total):
    """1 + floor(UNIT * (count + ADDED) / total) of arrays or numbers, exact; 0 terms have no price."""
    if total == 0:
        return count * 0
    rest = count + ADDED
    out = rest // total
    rest = rest - out * total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def galloping(small: np.ndarray, large: np.ndarray, stride: int = 512):
    """Places in both sorted arrays of the numbers they share.

    Stretches of the smaller array gallop through the larger one: steps double
    until they pass the stretch, and a binary search ends each hunt.
    """
    ours, theirs, low = [], [], 0
    for at in range(0, len(small), stride):
        part = small[at : at + stride]
        low += int(np.searchsorted(large[low : low + stride], part[0]))
        step = stride
        while low + step < len(large) and large[low + step] <= part[-1]:
            step *= 2
        window = large[low : low + step + 1]
        place = np.searchsorted(window, part)
        met = np.flatnonzero(place < len(window))
        met = met[window[place[met]] == part[met]]
        ours.append(at + met)
        theirs.append(low + place[met])
        if low >= len(large):
            break
    if not ours:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ours), np.concatenate(theirs)


def pair_cost(a, b):
    """(summed |p - q| over the terms that either has in a slice, number of those terms); a, b: (numbers, counts, total)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at_a, at_b = galloping(a[0], b[0])
    prices_a, prices_b = price(a[1], a[2]), price(b[1], b[2])
    zero_a, zero_b = price(0, a[2]), price(0, b[2])
    only_a, only_b = np.delete(prices_a, at_a), np.delete(prices_b, at_b)
    cost = np.abs(prices_a[at_a] - prices_b[at_b]).sum() + np.abs(only_a - zero_b).sum() + np.abs(only_b - zero_a).sum()
    return int(cost), len(a[0]) + len(b[0]) - len(at_a)


_COSTS = "lang string, a string, b string, cost long, terms long"


def _pair_costs(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in _COSTS.split(", ")]

    def groups(frame):
        return [(s, (np.asarray(i, np.int64), np.asarray(c, np.int64), t)) for s, i, c, t in frame.itertuples(index=False)]

    fields = ["source", "numbers", "counts", "total"]
    lang, _, block_a, block_b = key
    ours = groups(left[fields])
    if block_a == block_b:
        pairs = combinations(sorted(ours, key=lambda g: g[0]), 2)
    else:
        theirs = groups(right[fields])
        pairs = ((x, y) for x in ours for y in theirs)
    rows = [(lang, x[0], y[0], *pair_cost(x[1], y[1])) for x, y in pairs]
    return pd.DataFrame(rows, columns=names).astype({"cost": "int64", "terms": "int64"})


def _ranked(rows, top=None):
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def group_arrays(kept: DataFrame, groups: DataFrame, slices: int) -> DataFrame:
    """(lang, slice, block, source, total, numbers, counts): every group once for each slice, with sorted arrays."""
    in_slice = F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int")
    by_slice = Window.partitionBy("lang", "slice").orderBy("term")
    terms = kept.where("first").select("lang", "term", in_slice.alias("slice"))
    numbered = written(terms.withColumn("number", F.row_number().over(by_slice)), "term-numbers")
    pairs = kept.where("n > 0").join(numbered, ["lang", "term"])
    entries = F.array_sort(F.collect_list(F.struct("number", "n")))
    arrays = pairs.groupBy("lang", "source", "slice").agg(entries.alias("entries"))
    every = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    nothing = F.array().cast("array<struct<number:int,n:long>>")
    full = every.join(arrays, ["lang", "source", "slice"], "left").withColumn("entries", F.coalesce("entries", nothing))
    return full.select(
        "lang", "slice", "block", "blocks", "source", "total",
        F.col("entries.number").alias("numbers"), F.col("entries.n").alias("counts"),
    )


def pair_divergences(kept: DataFrame, groups: DataFrame, slices: int) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of groups of a language."""
    arrays = written(group_arrays(kept, groups, slices), "group-arrays")
    block = F.col("block")
    partners = F.sequence(block, F.col("blocks") - 1)
    left = arrays.withColumn("block_b", F.explode(partners)).withColumnRenamed("block", "block_a")
    # a block meets itself by its left side alone
    earlier = F.when(block > 0, F.sequence(F.lit(0), block - 1)).otherwise(F.array().cast("array<int>"))
    right = arrays.withColumn("block_a", F.explode(earlier)).withColumnRenamed("block", "block_b")
    keys = ["lang", "slice", "block_a", "block_b"]
    costs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_pair_costs, _COSTS)
    summed = costs.groupBy("lang", "a", "b").agg(F.sum("cost").alias("cost"), F.sum("terms").alias("terms"))
    absent = groups.select("lang", "vocabulary", "source", "absent")
    priced = (
        summed.join(absent.select("lang", F.col("source").alias("a"), "vocabulary", F.col("absent").alias("zero_a")), ["lang", "a"])
        .join(absent.select("lang", F.col("source").alias("b"), F.col("absent").alias("zero_b")), ["lang", "b"])
        .withColumn("value", F.col("cost") + (F.col("vocabulary") - F.col("terms")) * F.abs(F.col("zero_a") - F.col("zero_b")))
    )
    sides = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    return priced.select("lang", F.inline(sides), "value")


def _price_column(count, total):
    """``price`` as a column; null where there is no total."""
    share = (count + ADDED).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(total > 0, 1 + F.call_function("div", share, total.cast("decimal(20,0)")))


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources, and the terms that set a source apart."""
    kept = kept_counts(docs, least_documents)
    by_lang = kept.groupBy("lang").agg(
        F.count(F.when(F.col("first") & F.col("term").isNotNull(), 1)).alias("vocabulary"), F.sum("n").alias("lang_total")
    )
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = Window.partitionBy("lang")
    total = F.col("n") + ADDED * F.col("vocabulary")
    spread = F.greatest(F.lit(1), F.ceil(F.count("source").over(of_lang) / BLOCK_GROUPS)).cast("int")
    groups = sizes.join(by_lang, "lang").select(
        "lang", "source", "vocabulary", total.alias("total"),
        (F.col("lang_total") + ADDED * F.col("vocabulary")).alias("lang_total"),
        F.coalesce(_price_column(F.lit(0), total), F.lit(0).cast("long")).alias("absent"),
        spread.alias("blocks"),
    )
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = written(groups, "groups")
    largest = groups.agg(F.max("vocabulary")).first()[0] or 0
    pairs = pair_divergences(kept.where("term is not null"), groups, max(1, math.ceil(largest / SLICE_TERMS)))
    used = kept.where("term is not null and n > 0").join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    excess = _price_column(F.col("n"), F.col("total")) - _price_column(F.col("lang_n"), F.col("lang_total"))
    apart = used.select("lang", "source", F.col("term").cast("string").alias("item"), excess.alias("value")).where("value > 0")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        _ranked(pairs)
        .withColumn("part", F.lit("pair"))
        .select(*columns)
        .unionByName(_ranked(apart, top_terms).withColumn("part", F.lit("term")).select(*columns))
    )


def op12_pair_merge_divergence(spark, sf_dir):
    """Contract query over all of ``documents``."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SHARE = "1 + ({unit}::HUGEINT * ({n} + {added})) // ({total} + {added} * v)"


def _share(n, total):
    return _SHARE.format(unit=UNIT, n=n, added=ADDED, total=total)


OP12_SQL = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
words AS (SELECT row, lang, source, unnest(terms) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM texts) LEFT JOIN kept USING (lang) GROUP BY ALL),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM texts) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
prices AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_share("coalesce(c.n, 0)", "g.total")} AS p, {_share("k.n", "l.total")} AS q
    FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM prices WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
