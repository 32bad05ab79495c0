"""Benchmark decontamination through a distributed positional inverted index.

Training documents are cut into blocks; a block posts, for every term that some
test item contains, the term's positions. The index is a table of (block, term)
rows in the shared folder, so a term that fills a third of the corpus is spread
over all blocks. Corpus frequencies come from the index. A query window is
looked up in one block at a time: the list of its rarest term, moved back by the
term's offset, gives the candidate starts, and the lists of its other terms,
rarest first, thin them out. With ``slack`` 0 terms stand exactly at their
offsets (phrases); with more, each may be off by so many places (proximity).

Broadcast are the test terms, a dictionary of the words of the test items, and
the windows of at most ``WINDOWS_AT_ONCE`` items' windows at a time; more items
take more passes over the index. Documents are never gathered: a task holds one
block, or one document if that is longer.

Defined results: null and empty texts have no words and are clean; items without
words match nothing. Repeated rows stay, one result row each; repeated items
count once. A null item_id is written as the empty string. Without items every
document is clean; without documents the result is empty. Other columns are not
looked at.
"""

import uuid
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.llm.common import binary_values, without_rows, written

WINDOW_WORDS = 10
BLOCK_BYTES = 8 << 20
WINDOWS_AT_ONCE = 200_000
DOCUMENT_ROW = -1

# bytes of words: digits, a to z and everything outside ASCII; A to Z fold, the rest parts words
_FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes) -> list:
    return text.translate(_FOLDED).split()


def _index_rows(vocabulary):
    """Rows of the index for a stream of (doc_id, text) batches."""

    def block(ids, keys, lengths, found):
        codes = np.concatenate([c for c, _ in found]) if found else np.zeros(0, np.int32)
        places = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        codes, places = codes[order], places[order].astype("<u4")
        terms, first = np.unique(codes, return_index=True)
        cuts = [*first.tolist(), len(codes)]
        name = uuid.uuid4().hex
        no_id = np.array([i is None for i in ids], "u1").tobytes()
        packed_ids = np.array([[i or 0 for i in ids], keys], "<i8").tobytes()
        packed = [places[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_pydict(
            {
                "block": [name] * (len(terms) + 1),
                "term": pa.array([DOCUMENT_ROW, *terms.tolist()], pa.int32()),
                "n": pa.array([len(ids), *np.diff(cuts).tolist()], pa.int64()),
                "places": pa.array([np.array(lengths, "<u4").tobytes(), *packed], pa.binary()),
                "ids": pa.array([packed_ids + no_id, *repeat(None, len(terms))], pa.binary()),
            }
        )

    def rows(batches):
        code_of = vocabulary.value.get
        ids, keys, lengths, found, at, size = [], [], [], [], 0, 0
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), binary_values(batch.column(2))):
                if ids and size + len(text) > BLOCK_BYTES:
                    yield block(ids, keys, lengths, found)
                    ids, keys, lengths, found, at, size = [], [], [], [], 0, 0
                words = words_of(text)
                codes = np.fromiter(map(code_of, words, repeat(-1)), np.int32, len(words))
                posted = np.flatnonzero(codes >= 0)
                found.append((codes[posted], posted + at))
                ids.append(doc_id)
                keys.append(key)
                lengths.append(len(words))
                at += len(words)
                size += len(text)
        if ids:
            yield block(ids, keys, lengths, found)

    return rows


INDEX_SCHEMA = "block string, term int, n long, places binary, ids binary"


def positional_index(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """Postings of the terms in ``vocabulary`` (word as bytes to code) over ``docs`` (doc_id, text), written.

    One row a block and term with the sorted places in the block, and one row a
    block (term -1) with its documents' ids and word counts.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    columns = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text")
    return written(columns.mapInArrow(_index_rows(known), INDEX_SCHEMA), "postings")


def windows_of(words: list) -> list:
    """All windows of an item: runs of ten words, or the whole item if shorter."""
    size = min(WINDOW_WORDS, len(words))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []


def candidates(lists, slack):
    """Starts of a window; ``lists``: (offset, sorted places) of its terms, rarest first."""
    offset, places = lists[0]
    starts = places.astype(np.int64) - offset
    for offset, places in lists[1:]:
        wanted = starts + offset
        nearest = np.searchsorted(places, wanted - slack)
        inside = nearest < len(places)
        hit = np.zeros(len(starts), bool)
        hit[inside] = places[nearest[inside]] <= wanted[inside] + slack
        starts = starts[hit]
        if not len(starts):
            break
    return starts


def _block_hits(plan, slack):
    """Per document of one block: the hit ranges and the items that have occurring windows."""

    def hits(group: pd.DataFrame) -> pd.DataFrame:
        windows, items, rank = plan.value
        about = group["term"] == DOCUMENT_ROW
        lengths = np.frombuffer(group.loc[about, "places"].iloc[0], "<u4").astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])
        lists = {t: np.frombuffer(p, "<u4") for t, p in zip(group["term"], group["places"]) if t != DOCUMENT_ROW}
        ranges, of_items = {}, {}
        for window, owners in zip(windows, items):
            if not all(t in lists for t in window):
                continue
            order = sorted(range(len(window)), key=lambda k: rank[window[k]])
            starts = candidates([(k, lists[window[k]]) for k in order], slack)
            starts = starts[(starts >= 0) & (starts + len(window) <= first[-1])]
            docs = np.searchsorted(first, starts, side="right") - 1
            ends = starts + len(window)
            whole = ends <= first[docs + 1]
            for doc, start in zip(docs[whole].tolist(), starts[whole].tolist()):
                ranges.setdefault(doc, set()).add((start - int(first[doc]), len(window)))
                of_items.setdefault(doc, set()).update(owners)
        docs = list(ranges)
        listed = {
            "starts": [[s for s, _ in sorted(ranges[d])] for d in docs],
            "lengths": [[n for _, n in sorted(ranges[d])] for d in docs],
            "items": [sorted(of_items[d]) for d in docs],
        }
        # as objects: an empty column has no type of its own
        out = pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in listed.items()})
        out.insert(0, "slot", pd.Series(docs, dtype="int32"))
        out.insert(0, "block", group["block"].iloc[0])
        return out

    return hits


def _documents(batches):
    """(block, slot, doc_id, n_words) from the document rows of the index."""
    for batch in batches:
        for block, n, lengths, ids in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "places", "ids"))):
            missing = np.frombuffer(ids, "u1", n, 16 * n)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block] * n, pa.string()),
                    "slot": pa.array(range(n), pa.int32()),
                    "doc_id": pa.array(np.frombuffer(ids, "<i8", n), pa.int64(), mask=missing == 1),
                    "text_key": pa.array(np.frombuffer(ids, "<i8", n, 8 * n)),
                    "n_words": pa.array(np.frombuffer(lengths, "<u4").astype(np.int64)),
                }
            )


def _covered(starts, lengths):
    """How many places lie in the union of sorted ranges."""
    state = F.aggregate(
        F.arrays_zip(starts.alias("s"), lengths.alias("l")),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), r["s"] + r["l"] - F.greatest(acc["end"], r["s"]))).alias("n"),
            F.greatest(acc["end"], r["s"] + r["l"]).alias("end"),
        ),
    )
    return F.coalesce(state["n"], F.lit(0).cast("long"))


def matches(docs: DataFrame, benchmark: DataFrame, slack: int = 0) -> DataFrame:
    """(doc_id, text_key, n_words, starts, lengths, items) of every row of ``docs`` (doc_id, text).

    starts and lengths: the places, in words, where windows of items
    (``benchmark``: item_id, text) occur; text_key: a hash of the text; items: the item_ids as sorted strings.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("binary"))
    vocabulary = {}
    for _, text in items.toLocalIterator():
        for word in words_of(bytes(text or b"")):
            vocabulary.setdefault(word, len(vocabulary))
    index = positional_index(docs, vocabulary)
    totals = dict(index.where(F.col("term") >= 0).groupBy("term").agg(F.sum("n")).toLocalIterator())
    rank = {code: totals.get(code, 0) for code in vocabulary.values()}
    asked = ((w, item) for item, text in items.toLocalIterator() for w in windows_of(words_of(bytes(text or b""))))
    passes = []
    while part := list(islice(asked, WINDOWS_AT_ONCE)):
        owners = {}
        for window, item in part:
            codes = tuple(vocabulary[w] for w in window)
            if all(rank[c] for c in codes):
                owners.setdefault(codes, set()).add(item)
        plan = spark.sparkContext.broadcast((list(owners), [sorted(o) for o in owners.values()], rank))
        schema = "block string, slot int, starts array<long>, lengths array<long>, items array<string>"
        passes.append(index.groupBy("block").applyInPandas(_block_hits(plan, slack), schema))
    about = index.where(F.col("term") == DOCUMENT_ROW)
    listed = about.mapInArrow(_documents, "block string, slot int, doc_id long, text_key long, n_words long")
    if not passes:
        empty = F.array().cast("array<long>")
        return listed.select("doc_id", "text_key", "n_words", empty.alias("starts"), empty.alias("lengths"), F.array().cast("array<string>").alias("items"))
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    pieces = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "lengths"))))
    if len(passes) > 1:  # a document's hits from several passes
        found = found.groupBy("block", "slot").agg(
            pieces.alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        found = found.select("block", "slot", F.col("r.starts").alias("starts"), F.col("r.lengths").alias("lengths"), "items")
    none = F.array().cast("array<long>")
    return listed.join(found, ["block", "slot"], "left").select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("starts", none).alias("starts"),
        F.coalesce("lengths", none).alias("lengths"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items) of every row: how many words lie inside test windows."""
    hit = _covered(F.col("starts"), F.col("lengths"))
    return matches(docs, benchmark).select("doc_id", "text_key", "n_words", hit.alias("n_hit"), "items")


def op4_positional_index_decontamination(spark, sf_dir):
    """Contract query over all of ``documents`` and ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM item, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i)
  WHERE len(w) > 0
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), place AS (
  SELECT rid, s.k, i, list_slice(w, i, i + s.k - 1) AS g
  FROM doc, (SELECT DISTINCT k FROM win) AS s, unnest(range(1, len(w) - s.k + 2)) AS t(i)
), occ AS (
  SELECT rid, i, k, item_id FROM place JOIN win USING (k, g)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + k)) AS t(p) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM occ) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


def clean_documents(spark, docs, sf_dir):
    """Pipeline stage: documents that contain a test window go; all others stay as they are."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_rows(docs, found.where(F.col("n_hit") > 0))
