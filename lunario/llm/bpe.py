"""BPE encoding and decoding through a transducer of frequent words.

The text is cut at ASCII white space, which no token of this kind of vocabulary
crosses. How often every such word occurs is counted over all documents; the
most frequent ``lexicon_words`` of them, a fixed bound, are encoded once and
compiled into a minimal acyclic transducer (``transducer``). Its file goes into
the shared folder and from there to every executor, where tasks map it into
memory. Words that the lexicon lacks are merged exactly, pair by pair in the
order of the vocabulary file.

Defined results: null and empty texts have no ids and decode to the empty text.
Repeated rows stay, one result row each. An empty table gives an empty result
(and an empty lexicon). Other columns are not looked at. Very long texts are
encoded whole.
"""

import json
import mmap
import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.llm.common import binary_values, in_worker, scratch_path, written
from lunario.llm.transducer import Transducer, compiled

LEXICON_WORDS = 200_000
COUNTED_AT_ONCE = 300_000
TEXTS_AT_ONCE = 1000
REMEMBERED = 300_000
REMEMBERED_PIECES = 50_000
STABLE = "ɐ"  # below U+0250 all versions of Unicode agree


def byte_letters():
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Pieces:
    """Cuts a word into what is merged on its own: special tokens (ids), and pieces in lower case."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(spec)
        self.normal, self.pre = library.normalizer, library.pre_tokenizer
        self.bytes_of = {letter: bytes([b]) for b, letter in byte_letters().items()}
        spec = json.loads(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the vocabulary's own pattern; its white space is that of Unicode
        self.cut = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))

    def _foreign(self, text):
        """Pieces by the library's own tables: versions of Unicode differ in what is a letter and its lower case."""
        shown = self.pre.pre_tokenize_str(self.normal.normalize_str(text))
        return [b"".join(map(self.bytes_of.__getitem__, piece)).decode() for piece, _ in shown]

    def _plain(self, text):
        if text.isascii():
            text = text.lower()
        elif max(text) < STABLE:
            text = text.lower()
            if not text.isalpha() and max(text) >= STABLE:
                return self._foreign(text)
        else:
            return self._foreign(text)
        if text.isalpha():
            return (text,)
        if text[:-1].isalpha() and text[-1] in ",.":
            return text[:-1], text[-1]
        return self.cut.findall(text)

    def of(self, word: str):
        if self.specials is None or "<" not in word or not self.specials.search(word):
            return self._plain(word)
        out = []
        for part in self.specials.split(word):
            out += [self.special[part]] if part in self.special else self._plain(part) if part else ()
        return out


class ExactBpe:
    """Exact encoding of words with one vocabulary file (word ends marked, lower case, byte letters)."""

    def __init__(self, spec: str):
        self.pieces = Pieces(spec)
        spec = json.loads(spec)
        model = spec["model"]
        vocab, end = dict(model["vocab"]), model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # by pair of ids, the lowest rank first; where a pair is listed twice the later rank holds
        order = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.pairs = np.array(sorted(order), np.int64)
        self.rank = np.array([order[p] for p in self.pairs.tolist()] + [len(pairs)], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [-1], np.int64)
        self.none = len(pairs)
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        names = {i: t for t, i in (vocab | self.pieces.special).items()}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        self.known = {}

    def _ranks(self, left, right):
        """Rank of each pair of ids, ``none`` where it does not merge (an id of -1 never does)."""
        wanted = left << 32 | right
        at = np.searchsorted(self.pairs, wanted)
        there = self.pairs[np.minimum(at, len(self.pairs) - 1)] == wanted
        return self.rank[np.where(there & (right >= 0), at, len(self.pairs))]

    def _merge(self, pieces):
        """Ids of pieces of similar length, all merged in step: in each the lowest pair, the leftmost of equals."""
        data = [p.encode() for p in pieces]
        length = np.fromiter(map(len, data), np.int64, len(data))
        width = int(length.max())
        raw = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.uint8).reshape(len(data), width)
        ids = np.where(np.arange(width) < length[:, None], self.inner[raw], -1)
        ids[np.arange(len(data)), length - 1] = self.last[raw[np.arange(len(data)), length - 1]]
        done, rows = ids.copy(), np.arange(len(data))
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(rows) and ids.shape[1] > 1:
            at = ranks.argmin(1)
            lowest = ranks[np.arange(len(rows)), at]
            ended = lowest == self.none
            if ended.any():
                done[rows[ended], : ids.shape[1]] = ids[ended]
                done[rows[ended], ids.shape[1] :] = -1
                rows, ids, ranks, at, lowest = (x[~ended] for x in (rows, ids, ranks, at, lowest))
                if not len(rows):
                    break
            n, columns = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids[n, at] = self.merged[lowest]
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= at[:, None]), 1)
            for side in (at - 1, at):
                some = np.flatnonzero((side >= 0) & (side < ids.shape[1] - 1))
                ranks[some, side[some]] = self._ranks(ids[some, side[some]], ids[some, side[some] + 1])
        if len(rows):
            done[rows, : ids.shape[1]] = ids
            done[rows, ids.shape[1] :] = -1
        sizes = (done >= 0).sum(1)
        flat = done[done >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces):
        """Remember the packed ids of new pieces; short ones go many at a time."""
        pieces = sorted(pieces, key=len)
        at = 0
        while at < len(pieces):
            # about as many letters a round, whatever their lengths
            size = max(1, 65_536 // (4 + len(pieces[min(at + 4096, len(pieces)) - 1])))
            part = pieces[at : at + size]
            self.known.update(zip(part, self._merge(part)))
            at += size

    def encode_words(self, words: list) -> list:
        """Packed ids (little-endian unsigned 32-bit) of every word (str)."""
        if len(self.known) > REMEMBERED_PIECES:
            self.known.clear()
        cut = [(w.lower(),) if w.isascii() and w.isalpha() else self.pieces.of(w) for w in words]
        new = {p for pieces in cut for p in pieces if p not in self.known}
        self._learn([p for p in new if isinstance(p, str)])
        known = self.known
        return [
            b"".join([known[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in pieces]) for pieces in cut
        ]

    def decode(self, packed: list) -> pa.Array:
        """The texts of packed ids (bytes, four each): the token strings with a space between."""
        ends = np.cumsum([0, *map(len, packed)]) // 4
        ids = pa.array(np.frombuffer(b"".join(packed), "<u4"))
        tokens = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), self.names.take(ids).cast(pa.large_string()))
        return pc.binary_join(tokens, pa.scalar(" ", pa.large_string())).cast(pa.string())


def word_counts(texts: DataFrame, text="text") -> DataFrame:
    """(word, n) over all texts; words are cut at ASCII white space and counted per task first."""

    def count(batches):
        seen = Counter()
        for batch in batches:
            for value in binary_values(batch.column(0)):
                seen.update(value.split())
                if len(seen) > COUNTED_AT_ONCE:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    counted = texts.select(text).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen):
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])


def frequent_words(counts: DataFrame, at_most: int) -> list:
    """The words that occur at least as often as the at_most-th one, but never more than ``at_most`` of them."""
    counts = written(counts, "word-counts")
    above, floor = 0, None
    for row in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if above + row["words"] > at_most:
            break
        above, floor = above + row["words"], row["n"]
    if floor is None:
        return []
    return [bytes(r["word"]) for r in counts.where(F.col("n") >= floor).select("word").toLocalIterator()]


def _opened(name, spec):
    """The mapped lexicon, the exact encoder and the words met so far, once per worker process."""

    def made():
        with open(SparkFiles.get(name), "rb") as file:
            return Transducer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)), ExactBpe(spec.value), {}

    return in_worker(("bpe", name), made)


def encoded(texts: list, lexicon: Transducer, exact: ExactBpe, known: dict) -> list:
    """The ids of every text (bytes), as little-endian unsigned 32-bit integers.

    ``known`` keeps words for the next call; the words met first, which are the
    common ones, stay when it is full.
    """
    if len(known) > REMEMBERED:
        common = list(islice(known.items(), REMEMBERED // 2))
        known.clear()
        known.update(common)
    words = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    coded = words.values.cast(pa.large_binary()).dictionary_encode()  # white space at a text's ends gives empty words
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    packed = list(map(known.get, distinct))
    unknown = [k for k, ids in enumerate(packed) if ids is None]
    new = [distinct[k] for k in unknown]
    ranks = lexicon.ranks(new).tolist() if new else []
    known.update([(word, lexicon.ids_of(rank).tobytes()) for word, rank in zip(new, ranks) if rank >= 0])
    missing = [word for word, rank in zip(new, ranks) if rank < 0]
    known.update(zip(missing, exact.encode_words([word.decode() for word in missing])))
    for k, word in zip(unknown, new):
        packed[k] = known[word]
    ids = pa.array(packed, pa.large_binary()).take(coded.indices)
    lists = pa.LargeListArray.from_arrays(words.offsets.cast(pa.int64()), ids)
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).to_pylist()


class Codec:
    """Columns that encode and decode with one vocabulary file and a lexicon of frequent words."""

    def __init__(self, spark, vocabulary_path: str, words: list):
        with open(vocabulary_path, encoding="utf-8") as file:
            spec = file.read()
        exact = ExactBpe(spec)
        packed = exact.encode_words([w.decode() for w in words])
        blob = compiled([(w, np.frombuffer(b, "<u4").tolist()) for w, b in zip(words, packed)])
        path = scratch_path(spark, "lexicon")
        where, inside = pyarrow.fs.FileSystem.from_uri(path)
        where.create_dir(inside.rsplit("/", 1)[0])
        with where.open_output_stream(inside) as out:
            out.write(blob)
        spark.sparkContext.addFile(path)
        self.name, self.spec = path.rsplit("/", 1)[-1], spark.sparkContext.broadcast(spec)

    def encode(self, text):
        """Ids of a text column, packed as little-endian unsigned 32-bit integers."""
        name, spec = self.name, self.spec

        @F.arrow_udf("binary")
        def bpe_ids(texts: pa.Array) -> pa.Array:
            lexicon, exact, known = _opened(name, spec)
            parts = [pa.array([], pa.binary())]
            for low in range(0, len(texts), TEXTS_AT_ONCE):
                some = list(binary_values(texts.slice(low, TEXTS_AT_ONCE)))
                parts.append(pa.array(encoded(some, lexicon, exact, known), pa.binary()))
            return pa.concat_arrays(parts)

        return bpe_ids(text)

    def decode(self, ids):
        """The text of a column of packed ids: the token strings with a space between."""
        name, spec = self.name, self.spec

        @F.arrow_udf("string")
        def bpe_text(packed: pa.Array) -> pa.Array:
            exact, parts = _opened(name, spec)[1], [pa.array([], pa.string())]
            for low in range(0, len(packed), 1000):
                parts.append(exact.decode([b or b"" for b in packed.slice(low, 1000).to_pylist()]))
            return pa.concat_arrays(parts)

        return bpe_text(ids)


def codec_for(spark, docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS) -> Codec:
    """A codec whose lexicon holds the most frequent words of ``docs`` (text)."""
    return Codec(spark, vocabulary_path, frequent_words(word_counts(docs), lexicon_words))


def encoded_documents(spark, docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs`` (doc_id, text)."""
    codec = codec_for(spark, docs, vocabulary_path, lexicon_words)
    ids = docs.select("doc_id", codec.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", "ids", codec.decode(F.col("ids")).alias("decoded"))


def _digests(found):
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "ids",
    )


def op8_transducer_bpe(spark, sf_dir):
    """Contract query over all of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _digests(encoded_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))).drop("ids")


def token_documents(spark, docs, sf_dir):
    """Pipeline stage: every document's ids (packed unsigned 32-bit integers) with count and digests."""
    import public_tokenizers

    return _digests(encoded_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json")))
