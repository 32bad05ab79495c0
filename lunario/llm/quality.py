"""Quality by importance resampling over hashed n-grams.

Two generative models say how likely a text's hashed words and word pairs are:
one of target text (documents labelled good), one of raw text (all documents). The
mean log ratio of a document's n-grams says how much more it is like the target;
a cut on it is fitted on the labels. The log importance weight is the sum of the
log ratios less the cut, so long and short texts are measured alike. Adding
Gumbel noise to the log weights and taking the k largest samples k documents
without replacement in proportion to their weights; unless given, k is the
number of documents whose mean log ratio reaches the cut.

The raw model counts all n-grams of all documents; per task these are one array
of ``BUCKETS`` counts. The target model and the cut are fitted on labels of at
most ``SAMPLE`` rows a class, those with the smallest hash of doc_id. Noise is a
hash of doc_id and text, so a run can be repeated. The k-th largest key is found
by narrowing histograms; no task or driver holds all keys.

Defined results: null and empty texts have no n-grams, weight 0 and are
rejected. Repeated rows share a key, and ties at the k-th key are all kept.
Without labels of both classes all documents with words are accepted. An empty
table gives an empty result. Other columns are not looked at.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.llm.common import id_key, values, without_rows, written
from lunario.llm.toxicity import labelled_sample, logistic_fit

BUCKETS = 1 << 16
SAMPLE = 20_000
SEED = 42
REPEAT = 1
PRIOR = 0.5
BINS = 4096
TOKEN = re.compile(r"\w+|[^\w\s]+")


def ngram_buckets(text: str) -> np.ndarray:
    """Buckets of all words, marks and pairs of neighbours in a text."""
    crc = zlib.crc32
    words = np.array([crc(t.encode()) for t in TOKEN.findall(text)], np.uint64)
    pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    # a word said twice running is a pair of its own kind, whatever the word
    repeats = np.full(int((words[:-1] == words[1:]).sum()), REPEAT, np.uint64)
    return np.concatenate([words, pairs, repeats]).astype(np.int64) & (BUCKETS - 1)


def _bucket_counts(batches):
    """One row a task: the packed counts of its texts' n-grams."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in values(batch.column(0)):
            if text:
                total += np.bincount(ngram_buckets(text), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})


def bucket_model(texts: DataFrame) -> np.ndarray:
    """Log probability of every bucket in the column ``text``, smoothed."""
    counted = texts.select("text").mapInArrow(_bucket_counts, "bucket long, n long")
    counts = np.full(BUCKETS, PRIOR)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        counts[bucket] += n
    return np.log(counts / counts.sum())


def ratio_column(spark, ratio: np.ndarray, text):
    """struct(weight, n): the summed log ratios of a text and its number of n-grams."""
    shared = spark.sparkContext.broadcast(ratio)

    @F.arrow_udf("struct<weight: double, n: long>")
    def log_ratio(texts: pa.Array) -> pa.Array:
        weights, sizes = [], []
        for value in values(texts):
            found = ngram_buckets(value or "")
            weights.append(float(shared.value[found].sum()))
            sizes.append(len(found))
        return pa.StructArray.from_arrays([pa.array(weights, pa.float64()), pa.array(sizes, pa.int64())], ["weight", "n"])

    return log_ratio(text)


def kth_largest(keys: DataFrame, k: int):
    """The k-th largest value of the column ``key``, by histograms that narrow around it; None if there are fewer."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or k > n:
        return None
    while low < high:
        width = (high - low) / BINS
        if low + width <= low or high - width >= high:
            break
        inside = keys.where(F.col("key").between(low, high))
        place = F.least(F.lit(BINS - 1), F.floor((F.col("key") - low) / width))
        bins = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
        for _, count, a, b in sorted(bins.collect(), reverse=True):
            if k <= count:
                low, high = a, b
                break
            k -= count
        else:
            return low
    return low


class QualityModel:
    """Log ratios of the buckets and the cut on their mean."""

    def __init__(self, spark, docs: DataFrame, labels: DataFrame):
        self.spark = spark
        # no fold is held out: nothing is learned from documents without a label
        rows, totals = labelled_sample(docs, labels, "quality", -1, 2, SAMPLE)
        raw = bucket_model(docs)
        self.ratio = bucket_model(rows.where(F.col("label") == 1)) - raw
        got = rows.select("label", ratio_column(spark, self.ratio, F.col("text")).alias("r")).select("label", "r.*").where("n > 0").collect()
        y = np.array([r["label"] for r in got], float)
        self.cut = None
        if 0 < y.sum() < len(y):
            x = np.array([[r["weight"] / r["n"], 1.0] for r in got])
            sizes = [len(y) - y.sum(), y.sum()]
            share = np.array([max(t, 1) / s for t, s in zip(totals, sizes)])
            slope, shift = logistic_fit(x, y, (share / share.max())[y.astype(int)])
            if slope > 0:
                self.cut = -shift / slope

    def weighed(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text_key, log_weight, n_grams, key) of every row, written; key: log weight with Gumbel noise."""
        text_key = F.xxhash64("text")
        found = docs.select("doc_id", text_key.alias("text_key"), ratio_column(self.spark, self.ratio, F.col("text")).alias("r"))
        # uniform in (0, 1) from 52 bits of a hash
        uniform = (F.shiftrightunsigned(F.xxhash64(id_key(F.col("doc_id")), "text_key", F.lit(SEED)), 12) + 0.5) / 2.0**52
        noise = -F.log(-F.log(uniform))
        weight = F.col("r.weight") - (self.cut or 0.0) * F.col("r.n")
        table = found.select("doc_id", "text_key", weight.alias("log_weight"), F.col("r.n").alias("n_grams"))
        return written(table.withColumn("key", F.col("log_weight") + noise), "weights")

    def sampled(self, docs: DataFrame, k: int | None = None) -> DataFrame:
        """``weighed`` with selected: whether the document is among the k sampled."""
        table = self.weighed(docs)
        worded = table.where(F.col("n_grams") > 0)
        if k is None:
            k = worded.where(F.lit(True) if self.cut is None else F.col("log_weight") >= 0).count()
        least = kth_largest(worded, min(k, worded.count()))
        chosen = F.lit(False) if least is None else (F.col("n_grams") > 0) & (F.col("key") >= least)
        return table.withColumn("selected", chosen)


def op5_importance_resampling(spark, sf_dir):
    """All of ``documents`` with log weight, Gumbel key and whether the document is sampled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = QualityModel(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.sampled(docs).drop("text_key")


def good_documents(spark, docs, sf_dir):
    """Pipeline stage: documents that the sampler rejects go; all others stay as they are."""
    model = QualityModel(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without_rows(docs, model.sampled(docs).where(~F.col("selected")))
