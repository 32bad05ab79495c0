"""BPE and record files against the tokenizers library; the transducer against a dictionary."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from llmdata import SF_DIR  # noqa: E402
from lunario.llm.bpe import ExactBpe, encoded, encoded_documents, frequent_words, op8_transducer_bpe, word_counts  # noqa: E402
from lunario.llm.records import (  # noqa: E402
    WordEncoder,
    framed,
    masked,
    op3_framed_records,
    payload_of,
    read_records,
    records_in,
    write_records,
)
from lunario.llm.transducer import Transducer, compiled  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abcXYZ's't're 12é́ΣσİßﬁẛǄ \x1c\x1d\x85  !?.#<|endoftext|>中\U0001f600्̣١½\n\t\x0b\\"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def noise(n):
    draw = random.Random(1)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 14))) for _ in range(n)]
    return [t + "<|endoftext|>" + t if k % 9 == 0 else t for k, t in enumerate(texts)]


def test_exact_merges_equal_the_library(library, spec):
    exact, lexicon = ExactBpe(spec), Transducer(compiled([]))
    texts = [*noise(4000), "a" * 3000, "x" * 200 + "é" * 500, "the The THE, the."]
    for text, packed in zip(texts, encoded([t.encode() for t in texts], lexicon, exact, {})):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text)
        assert exact.decode([packed]).to_pylist() == [library.decode(ids, skip_special_tokens=False)]
    assert exact.decode([b"", b""]).to_pylist() == ["", ""] and exact.decode([]).to_pylist() == []


def test_a_repeated_word_is_looked_up_once(library, spec):
    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

        def get(self, word):
            self.asked += 1
            return super().get(word)

    known, text = Counted(), " the  cat\x0bThe Qzx, é.\x1f\n" * 500
    for packed in encoded([text.encode(), b"", b" ", b"cat"], Transducer(compiled([])), ExactBpe(spec), known)[:1]:
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert known.asked <= 14  # seven distinct words, the empty one too


def test_word_encoder_equals_the_library(library, spec):
    texts = noise(4000)
    for text, packed in zip(texts, map(WordEncoder(spec).encode, [t.encode() for t in texts])):
        assert np.frombuffer(packed, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_every_code_point_equals_the_library(library, spec):
    """Between two letters, whatever version of Unicode this Python has: assigned or not."""
    points = [p for p in [*range(0x20000), *range(0x20000, 0x110000, 101)] if not 0xD800 <= p < 0xE000]
    words, exact, lexicon, known = WordEncoder(spec), ExactBpe(spec), Transducer(compiled([])), {}
    for low in range(0, len(points), 500):
        texts = [f"Ab{chr(p)}cD" for p in points[low : low + 500]]
        wanted = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        for text, ids, packed in zip(texts, wanted, encoded([t.encode() for t in texts], lexicon, exact, known)):
            assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text)
            assert np.frombuffer(words.encode(text.encode()), "<u2").tolist() == [*ids, 1], repr(text)


def test_op8_equals_the_library(spark, texts, library):
    rows = {r["doc_id"]: tuple(r)[1:] for r in op8_transducer_bpe(spark, SF_DIR).collect()}
    assert set(rows) == set(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        packed = np.array(ids, "<u4").tobytes()
        expected = len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        assert rows[doc_id] == expected


def test_lexicon_size_changes_nothing(spark, edge):
    few, many = (
        sorted(map(str, encoded_documents(spark, edge, PATH, size).select("doc_id", "ids", "decoded").collect()))
        for size in (2, 100_000)
    )
    assert few == many


def test_frequent_words_are_the_most_frequent(spark, documents, texts):
    words = frequent_words(word_counts(documents), 500)
    count = {}
    for text in texts.values():
        for word in (text or "").encode().split():
            count[word] = count.get(word, 0) + 1
    assert 0 < len(words) <= 500
    least = min(count[w] for w in words)
    assert set(words) == {w for w, n in count.items() if n >= least}


def test_transducer_is_minimal_and_exact():
    draw = random.Random(2)
    words = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 7))).encode() for _ in range(900)} | {b"", b"\xff\x00"}
    table = {w: [draw.randrange(50_000) for _ in range(draw.randint(0, 4))] for w in words}
    lexicon = Transducer(compiled(table.items()))
    asked = [*words, *(w + b"d" for w in words), b"zz"]
    ranks = lexicon.ranks(asked).tolist()
    for word, rank in zip(asked, ranks):
        assert (rank >= 0) == (word in table)
        if rank >= 0:
            assert lexicon.ids_of(rank).tolist() == table[word]
    # states are as many as there are different sets of endings
    endings = {p: frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in [w[:k] for k in range(len(w) + 1)]}
    assert len(lexicon.final) == len(set(endings.values()))
    assert Transducer(compiled([])).ranks([b"a", b""]).tolist() == [-1, -1]


def test_op3_equals_the_library(spark, texts, library):
    rows = sorted(map(tuple, op3_framed_records(spark, SF_DIR).collect()))
    expected, start = [], 0
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows == expected


def test_any_part_of_the_index_can_be_read(spark, edge):
    index, folder = write_records(spark, edge, PATH)
    whole = {tuple(r) for r in read_records(index, folder).collect()}
    some = {tuple(r) for r in read_records(index.where("place % 3 = 1"), folder).collect()}
    assert some and some < whole
    starts = sorted(r["start"] for r in index.collect())
    assert len(set(starts)) == edge.count() and starts[0] == 0
    # null ids come first
    assert {r["start"] for r in index.where("doc_id is null").collect()} == set(starts[:2])


def test_damage_is_noticed():
    record = framed(payload_of(7, b"\x01\x00\x02\x00", 2))
    assert len(list(records_in(pa.BufferReader(record), 0, len(record)))) == 1
    for at in range(len(record)):
        broken = bytearray(record)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            list(records_in(pa.BufferReader(bytes(broken)), 0, len(record)))
    assert masked(b"") == 0xA282EAD8
