"""Token ids as length-delimited binary records with a separate offset index.

Documents are dealt to tasks by ranges of doc_id, so the files together hold
them in ascending order. A task encodes its documents with the tokenizers
library, appends the end id and writes one file. A record is framed as

    length (8 bytes) | masked crc32 of the length (4) | payload | masked crc32 of the payload (4)

all little-endian; the mask rotates the checksum right by 15 bits and adds a
constant, so that a checksum stored inside data is not taken for its own. The
payload starts with doc_id (8 bytes), a flag for a null doc_id (1) and the width
of an id in bytes (1: two or four, by the largest id of the vocabulary), then
the ids follow.

The index, a table beside the files, has one row a record: file, offset, length
and the number of ids before it, so that shuffled reads can open any record.
A file's name is unique to the attempt that wrote it, and only files that the
index names count: an attempt that was lost or ran twice leaves a file that no
one reads. Files go through Arrow's file systems, so any store it knows will do.

Texts are cut at ASCII white space, which no token of this vocabulary crosses.
Words repeat, so a worker remembers the ids of words, up to a stated number of
bytes. A new word of code points below U+0250, where no version of Unicode differs,
is cut into pieces by the vocabulary's rules and merged by the library's model; any
other new word goes through the whole library.

Defined results: null and empty texts are a record of the end id alone. Null
doc_ids come first; rows with one doc_id are ordered by a hash of their text and
repeated rows stay. An empty table gives no files and an empty index. Other columns are not
looked at. Very long texts are encoded whole.
"""

import struct
import uuid
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lunario.llm.bpe import STABLE, Pieces, byte_letters
from lunario.llm.common import binary_values, in_worker, scratch_path, written

END_ID = 1
HEAD = struct.Struct("<QI")
FOOT = struct.Struct("<I")
ABOUT = struct.Struct("<qBB")
MASK_DELTA = 0xA282EAD8
REMEMBERED_BYTES = 64 << 20
ENTRY_BYTES = 200  # two short bytes objects and their place in a dictionary
TEXTS_AT_ONCE = 500
INDEX = "doc_id long, file string, place long, offset long, length long, n_tokens long, inside long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + FOOT.pack(masked(length)) + payload + FOOT.pack(masked(payload))


def payload_of(doc_id, ids: bytes, width: int) -> bytes:
    return ABOUT.pack(doc_id or 0, doc_id is None, width) + ids


def opened(payload: bytes):
    """(doc_id, ids) of a payload."""
    doc_id, missing, width = ABOUT.unpack_from(payload)
    return None if missing else doc_id, np.frombuffer(payload, f"<u{width}", offset=ABOUT.size)


def records_in(stream, offset, size):
    """Payloads of the records in ``size`` bytes from ``offset``, lengths and checksums verified."""
    stream.seek(offset)
    end = offset + size
    while offset < end:
        head = stream.read(HEAD.size)
        length, crc = HEAD.unpack(head)
        if masked(head[:8]) != crc:
            raise ValueError(f"damaged length at byte {offset}")
        payload = stream.read(length)
        if len(payload) != length or FOOT.unpack(stream.read(FOOT.size))[0] != masked(payload):
            raise ValueError(f"damaged record at byte {offset}")
        offset += HEAD.size + length + FOOT.size
        yield payload


class WordEncoder(dict):
    """Packed ids of words (bytes): a word met for the first time is merged by the tokenizers library's model."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = library = Tokenizer.from_str(spec)
        library.no_truncation()
        library.no_padding()
        self.merge = library.model.tokenize
        self.pieces = Pieces(spec)
        self.letters = byte_letters()
        largest = max([*library.get_vocab(with_added_tokens=True).values(), END_ID])
        self.width = 2 if largest < 1 << 16 else 4
        self.packed = [i.to_bytes(self.width, "little") for i in range(largest + 1)]
        self.end = self.packed[END_ID]

    def __missing__(self, word):
        if len(self) * ENTRY_BYTES > REMEMBERED_BYTES:
            # the words met first are the common ones; they stay
            common = list(islice(self.items(), len(self) // 2))
            self.clear()
            self.update(common)
        text = word.decode()
        if not text.isascii() and max(text) >= STABLE:
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = []
            for piece in self.pieces.of(text):
                if isinstance(piece, int):
                    ids.append(piece)
                else:
                    # one letter a byte; plain ASCII is its own letters
                    shown = piece if piece.isprintable() and piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                    ids += [t.id for t in self.merge(shown)]
        packed = b"".join(map(self.packed.__getitem__, ids))
        if len(word) <= ENTRY_BYTES // 2:  # a longer one is hardly met again
            self[word] = packed
        return packed

    def encode(self, text):
        """Packed ids of a text (bytes) with the end id."""
        return b"".join(map(self.__getitem__, text.split())) + self.end


def _written_files(spec, folder):
    def write(batches):
        # later tasks find the words that earlier ones have met
        encoder = in_worker(("records", hash(spec.value)), lambda: WordEncoder(spec.value))
        out, name, place, at, inside_file = None, None, 0, 0, 0
        try:
            for batch in batches:
                for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
                    part, rows = batch.slice(low, TEXTS_AT_ONCE), []
                    texts = binary_values(part.column(1))
                    for doc_id, ids in zip(part.column(0).to_pylist(), map(encoder.encode, texts)):
                        if out is None:
                            store, inside = pyarrow.fs.FileSystem.from_uri(folder)
                            store.create_dir(inside)
                            name = f"{uuid.uuid4().hex}.rec"
                            out = store.open_output_stream(f"{inside}/{name}")
                        record = framed(payload_of(doc_id, ids, encoder.width))
                        out.write(record)
                        n = len(ids) // encoder.width
                        rows.append((doc_id, name, place, at, len(record), n, inside_file))
                        place, at, inside_file = place + 1, at + len(record), inside_file + n
                    if rows:
                        yield _batch(rows)
        finally:
            if out is not None:
                out.close()

    return write


_KINDS = [pa.int64(), pa.string(), *[pa.int64()] * 5]


def _batch(rows):
    names = [c.split()[0] for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names)


def write_records(spark, docs: DataFrame, vocabulary_path: str):
    """(index, folder) of the record files of ``docs`` (doc_id, text).

    index: doc_id, file, file_no (files in ascending order of doc_id), place (in
    the file), offset, length, n_tokens, start (ids of all records before it).
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    folder = scratch_path(spark, "records")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    order = [F.asc_nulls_first("doc_id"), F.asc("text_key")]
    # by text too, or rows of one doc_id, or of none, would all meet in one task
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.asc_nulls_first("text"))
    dealt = dealt.select("doc_id", "text").mapInArrow(_written_files(spec, folder), INDEX)
    index = written(dealt.withColumn("file_no", F.spark_partition_id()), "record-index")
    # one row a file: their order is that of the ranges
    sums = index.groupBy("file_no", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    started = index.join(bases, "file").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")
    return started, folder


def _read_files(folder):
    def read(batches):
        store, inside = pyarrow.fs.FileSystem.from_uri(folder)
        stream, open_file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            out = []
            for name, offset, length, start in rows:
                if name != open_file:
                    if stream is not None:
                        stream.close()
                    stream, open_file = store.open_input_file(f"{inside}/{name}"), name
                (payload,) = records_in(stream, offset, length)
                doc_id, ids = opened(payload)
                out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
        if stream is not None:
            stream.close()

    return read


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the records that ``index`` rows name, read from the files.

    Rows are dealt by file and stretch of places and read in the order of their
    offsets; any subset of an index will do.
    """
    stretch = F.floor(F.col("place") / 4096)
    # a given number of tasks: the index is small against the files it names
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return dealt.select("file", "offset", "length", "start").mapInArrow(_read_files(folder), schema)


def op3_framed_records(spark, sf_dir):
    """Contract query over all of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_records(*write_records(spark, docs, public_tokenizers.path("word_bpe_49k.json")))
