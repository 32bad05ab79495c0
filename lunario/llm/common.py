"""Helpers that several operators share."""

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import functions as F

from lunario.plans.frames import table
from lunario.session import scratch_path, written

__all__ = ["binary_values", "bucket_of", "in_worker", "learning_labels", "scratch_path", "table", "values", "without_rows", "written"]


AT_ONCE = 256


def values(column: pa.Array):
    """The values of a column as Python objects, a slice at a time: a batch of texts is large beside what a task keeps."""
    for low in range(0, len(column), AT_ONCE):
        yield from column.slice(low, AT_ONCE).to_pylist()


def binary_values(texts: pa.Array):
    """The UTF-8 bytes of every text, a slice at a time; null is empty."""
    for low in range(0, len(texts), AT_ONCE):
        for value in texts.slice(low, AT_ONCE).cast(pa.binary()).to_pylist():
            yield value or b""


_HELD = {}


def in_worker(key, make):
    """What tasks work with, made once a worker process; only the one asked for last is kept.

    Workers outlive their stage: whatever another model or operator left behind goes
    before the new one is made, and its memory back to the system.
    """
    if key not in _HELD:
        _HELD.clear()
        _give_back()
        _HELD[key] = make()
    return _HELD[key]


def _give_back():
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def bucket_of(doc_id, modulus):
    """crc32 of the id as text, modulo ``modulus``: the folds that contracts name."""
    return F.crc32(doc_id.cast("string")) % modulus


def learning_labels(labels, name):
    """One 0/1 label a document: rows without id or label go, of contradicting rows the larger label stays."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(name).cast("int").alias("label"))
    )


def id_key(doc_id):
    """A key that joins null ids as well."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def without_rows(docs, gone):
    """``docs`` without the rows whose doc_id and text (``gone``: doc_id, text_key = xxhash64 of it) are listed."""
    gone = gone.select(id_key(F.col("doc_id")).alias("id_key"), "text_key").distinct()
    rows = docs.select(F.struct("*").alias("doc"), id_key(F.col("doc_id")).alias("id_key"), F.xxhash64("text").alias("text_key"))
    return rows.join(gone, ["id_key", "text_key"], "left_anti").select("doc.*")
