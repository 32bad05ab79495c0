"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three letters, words padded)
of a language's training texts, most frequent first. A document is compared by
the out-of-place distance: for each of its own most frequent n-grams, by how
many places its rank differs from that in the profile, or the greatest distance
if the profile lacks it. The nearest language wins.

Profiles count all texts outside the held-out fold. N-grams are counted by text,
summed per task and language, then over the cluster; only the profiles,
``PROFILE`` n-grams a language, reach the driver. Letters are what Unicode's letter
categories hold; anything else parts words.

Defined results: a text that is null or without letters is ``und`` with score 0,
and so is every text if no language was learned. Ties go to the smaller language
name, ties in frequency to the smaller n-gram. A null doc_id belongs to no fold,
is learned from and is not held out. Very long texts are counted whole, a stretch at
a time. Repeated rows stay, one result row each. An
empty table gives an empty result. Other columns are not looked at.
"""

import unicodedata
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lunario.llm.common import bucket_of, values

FOLDS, HELD_OUT = 4, 2
PROFILE = 400
STRETCH = 1 << 20
MERGED_AT_ONCE = 1 << 20
COUNTED_AT_ONCE = 300_000
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Which code points are letters, by Unicode's letter categories."""
    return np.array([unicodedata.category(chr(p))[0] == "L" for p in range(0x110000)])


def summed(codes: np.ndarray, counts: np.ndarray):
    """Distinct codes in order and the sums of their counts."""
    found, place = np.unique(codes, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def grams(text: str):
    """(code, count) of the n-grams of a text's words, each word with a blank on both sides; 21 bits a letter.

    The words with single blanks between them are one array: its letters, its
    neighbours and its triples without a blank in the middle are the n-grams.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letters()[points]
    follows = np.concatenate([[False], letter[:-1]])
    kept = np.flatnonzero(letter | follows)
    line = np.concatenate([[32], np.where(letter[kept], points[kept], 32), [32]]).astype(np.int64)
    if len(kept) and not letter[kept[-1]]:
        line = line[:-1]
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for low in range(0, len(line), STRETCH):
        part = line[low : low + STRETCH + 2]
        own = min(STRETCH, len(line) - low)
        one, two = part[:own], part[:-1][:own] << 21 | part[1:][:own]
        three = part[:-2][:own] << 42 | part[1:-1][:own] << 21 | part[2:][:own]
        three = three[part[1:-1][:own] != 32]
        found, count = np.unique(np.concatenate([one[one != 32], two, three]), return_counts=True)
        codes, counts = (found, count) if not low else summed(np.concatenate([codes, found]), np.concatenate([counts, count]))
    return (codes, counts) if len(kept) else (codes[:0], counts[:0])


def _training_counts(batches):
    """(lang, gram, n) per task: the n-grams of each text first, then their sums by language."""
    held = defaultdict(list)

    def rows():
        for lang, parts in held.items():
            found, total = parts[0]
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(found), pa.string()), "gram": pa.array(found), "n": pa.array(total)}
            )
        held.clear()

    def merge():
        for parts in held.values():
            parts[:] = [summed(*map(np.concatenate, zip(*parts)))]

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), values(batch.column(1))):
            found = grams(text or "")
            held[lang].append(found)
            size += len(found[0])
            if size > MERGED_AT_ONCE:
                merge()
                size = 0
                if sum(len(parts[0][0]) for parts in held.values()) > COUNTED_AT_ONCE:
                    yield from rows()
    merge()
    yield from rows()


class LanguageProfiles:
    """Ranked n-grams per language."""

    def __init__(self, ranked: dict):
        self.names = sorted(ranked)
        self.codes = np.unique(np.concatenate([ranked[k] for k in self.names])) if ranked else np.zeros(0, np.int64)
        self.place = np.full((len(self.names), len(self.codes)), -1, np.int64)
        for row, name in enumerate(self.names):
            self.place[row, np.searchsorted(self.codes, ranked[name])] = np.arange(len(ranked[name]))

    def nearest(self, text: str):
        """(language, score); the score says by what part the second language is further off."""
        codes, count = grams(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = np.argsort(-count, kind="stable")[:PROFILE]
        wanted = codes[top]
        at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
        there = self.codes[at] == wanted
        ranks = self.place[:, at]
        off = np.where(there & (ranks >= 0), np.abs(ranks - np.arange(len(top))), PROFILE).sum(1)
        order = np.argsort(off, kind="stable")
        best = off[order[0]]
        second = off[order[1]] if len(order) > 1 else PROFILE * len(top)
        return self.names[order[0]], float(1 - best / second) if second else 0.0


def profiles_of(docs: DataFrame) -> LanguageProfiles:
    """Profiles of the languages of ``docs`` (doc_id, text, lang) outside the held-out fold."""
    learned = F.coalesce(bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(True)) & F.col("lang").isNotNull()
    counted = docs.where(learned).select("lang", "text").mapInArrow(_training_counts, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PROFILE)
    ranked = defaultdict(list)
    for row in sorted(top.select("lang", "rank", "gram").collect()):
        ranked[row["lang"]].append(row["gram"])
    return LanguageProfiles(ranked)


def language_column(spark, profiles: LanguageProfiles, text):
    """struct(lang, score) of a text column."""
    shared = spark.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<lang: string, score: double>")
    def language(texts: pa.Array) -> pa.Array:
        nearest = shared.value.nearest
        found = [nearest(t or "") for t in values(texts)]
        langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
        return pa.StructArray.from_arrays([langs, scores], ["lang", "score"])

    return language(text)


def op9_rank_order_language(spark, sf_dir):
    """Contract query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    found = docs.select(
        "doc_id", held_out.alias("held_out"), language_column(spark, profiles_of(docs), F.col("text")).alias("found")
    )
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
