"""SimHash near-duplicates by a binary trie self-join.

A fingerprint sums the bits of XXH64 hashes over 4-word shingles (repeats
count). Equal fingerprints form one class; the distinct ones are cut into
shards by their first bits, the top of the trie, and each pair of shards whose
prefixes lie within the budget is one task that walks the two subtries together
(``trie_join``). A task returns a spanning forest of its links, never all of
them, so a group of n near copies costs n rows; the forests are joined into
components over the cluster.

Defined results: null and empty texts have no words and the fingerprint zero,
which links like any other. Repeated rows stay, one result row each. A null
doc_id is kept; it never names a component unless the whole component has none.
An empty table gives an empty result. Other columns are not looked at.
"""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lunario.llm.common import binary_values, id_key, written
from lunario.llm.components import components
from lunario.llm.trie_join import class_roots

SHINGLE_WORDS = 4
SEED = 42
BUDGET = 4
SHARD_CODES = 32_768


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    words = text.lower().split()
    n = len(words) - SHINGLE_WORDS + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: n - 1]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE_WORDS - 1 :] - 1).tolist())]
    # in pieces, so that a very long text needs no wide bit table
    ones = np.zeros(64, np.int64)
    codes = np.array(hashes, np.uint64)
    for at in range(0, len(codes), 4096):
        part = codes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(codes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text):
    """SimHash of a text column as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        codes = np.array([fingerprint(t) for t in binary_values(texts)], np.uint64)
        return pa.array(codes.view(np.int64))

    return simhash(text)


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    codes = np.sort(group["code"].to_numpy().view(np.uint64))
    return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "codes": [codes.tobytes()]})


def _forest(budget):
    def walk(group: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(b, np.uint64) for _, b in sorted(zip(group["shard"], group["codes"]))]
        own = group["low"].iloc[0] == group["high"].iloc[0]
        if len(runs) < 2 and not own:
            runs = [np.zeros(0, np.uint64)]
        codes = np.concatenate(runs)
        root = class_roots(codes, None if own else len(runs[0]), budget)
        moved = np.flatnonzero(root != np.arange(len(codes)))
        return pd.DataFrame({"a": codes[moved].view(np.int64), "b": codes[root[moved]].view(np.int64)})

    return walk


def links(codes: DataFrame, budget: int = BUDGET, shard_codes: int = SHARD_CODES) -> DataFrame:
    """Spanning forests (a, b) of all links within ``budget`` bits among distinct codes (column ``code``)."""
    bits = max(0, math.ceil(math.log2(max(1, codes.count()) / shard_codes)))
    shard = F.shiftrightunsigned("code", 64 - bits) if bits else F.lit(0).cast("long")
    shards = codes.select("code", shard.alias("shard")).groupBy("shard").applyInPandas(_packed, "shard long, codes binary")
    shards = written(shards, "shards")
    masks = [sum(1 << b for b in c) for k in range(min(bits, budget) + 1) for c in combinations(range(bits), k)]
    other = F.col("shard").bitwiseXOR(F.col("mask"))
    pairs = shards.select("shard", "codes", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    pairs = pairs.select("shard", "codes", F.least("shard", other).alias("low"), F.greatest("shard", other).alias("high"))
    return pairs.groupBy("low", "high").applyInPandas(_forest(budget), "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shard_codes: int = SHARD_CODES) -> DataFrame:
    """(doc_id, text_key, code, root_code, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id among all rows that a chain of links
    reaches, root_code names the component, text_key is a hash of the text.
    """
    columns = ["doc_id", F.xxhash64("text").alias("text_key"), fingerprint_column(F.col("text")).alias("code")]
    coded = written(docs.select(*columns), "codes")
    classes = written(coded.groupBy("code").agg(F.min("doc_id").alias("first")), "classes")
    forest = written(links(classes.select("code"), budget, shard_codes), "forests")
    roots = components(forest).withColumnsRenamed({"node": "code", "root": "root_code"})
    placed = classes.join(roots, "code", "left").withColumn("root_code", F.coalesce("root_code", "code"))
    named = placed.groupBy("root_code").agg(F.min("first").alias("component_id"))
    by_code = written(placed.join(named, "root_code").select("code", "root_code", "component_id"), "components")
    return coded.join(by_code, "code").select("doc_id", "text_key", "code", "root_code", "component_id")


def op10_simhash_near_dedup(spark, sf_dir):
    """Contract query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def kept_documents(spark, docs, sf_dir):
    """Pipeline stage: of every component one row stays.

    It is a row with the smallest doc_id (null last), of those one with the
    smallest text hash, and of fully repeated rows one.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best")
    keep = near_duplicates(docs).groupBy("root_code").agg(best).select(id_key(F.col("best.doc_id")).alias("id_key"), "best.text_key")
    keep = written(keep, "kept")
    rows = docs.select(F.struct("*").alias("doc"), id_key(F.col("doc_id")).alias("id_key"), F.xxhash64("text").alias("text_key"))
    repeats = Window.partitionBy("id_key", "text_key").orderBy(F.xxhash64("doc"))
    found = rows.join(keep, ["id_key", "text_key"]).withColumn("repeat", F.row_number().over(repeats))
    return found.where(F.col("repeat") == 1).select("doc.*")

