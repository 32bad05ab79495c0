"""Byte-level BPE ids by the tokenizers library, with words remembered.

The cutting rule of such a vocabulary takes a blank together with the word that
follows it, so a text may be cut in front of a blank unless white space stands
on both sides of it (the text's end counts as white space there). Special
tokens are cut out first. What lies between two cuts repeats, so many texts go
at a time: their distinct stretches are looked up once, and the ids are gathered
through Arrow. The stretches met first, the common ones, are remembered with
their packed ids, up to a stated number of bytes.

A new stretch of ASCII without apostrophes and of letters from U+00C0 to U+024F, where
no version of Unicode differs, goes straight to the library's merges. Many go at a time,
a line each: no merge joins letters, digits, marks and line ends, or a blank to what
stands before it, so none crosses what the cutting rule parts (looked up in the
vocabulary). Any other new stretch goes through the whole library. A mark behind a word
of letters is a stretch of its own.
"""

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lunario.llm.bpe import byte_letters

REMEMBERED_BYTES = 8 << 20
JOINED = 200  # stretches in one string
MARKS = ",.;:!?"

_INSIDE = re.compile(r"\s (?:\s|\Z)")
_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")
_BLANK = re.compile("(?= )")
# the same white space as Python's, and the straight stretches, for Arrow
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CARE = rf"{_WHITE} (?:{_WHITE}|\z)"
_LATIN = r"\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_MARKED = rf"\A[A-Za-z{_LATIN}]+[{MARKS}]\z"
_STRAIGHT = rf"\A[!-&(-~{_LATIN}]+(?:\n[!-&(-~{_LATIN}]+)*\z"

_LETTERS = byte_letters()
# first bytes of those letters, and bytes that go on with a letter
_FIRST, _ON = ({_LETTERS[b] for b in range(*ends)} for ends in ((0xC3, 0xCA), (0x80, 0xC0)))


def _kind(letter):
    if letter in _FIRST or letter.isascii() and letter.isalpha():
        return "a"
    if letter.isascii() and letter.isdigit():
        return "0"
    return letter if letter in "ĠĊ" else "." if letter.isascii() and letter != "'" else None


def _last_kind(token):
    if token[-1] in _FIRST:
        return None  # goes on inside the letter
    return "a" if token[-1] in _ON and (len(token) == 1 or token[-2] in _FIRST) else _kind(token[-1])


def kept_apart(merges) -> bool:
    """Whether no merge crosses what the cutting rule parts in a straight stretch and the blank before it."""
    edges = {(_last_kind(a), _kind(b[0])) for a, b in merges}
    return all(x in (y, "Ġ") or None in (x, y) for x, y in edges)


class ByteBpe:
    """Packed ids (little-endian, ``width`` bytes each) of whole texts."""

    def __init__(self, spec: str, remembered: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(spec)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.heads = {s[:2] for s in specials}
        self.letters = np.array([ord(_LETTERS[b]) for b in range(256)], "<u4")
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.apart = kept_apart(merges)
        self.merges = Tokenizer(self.library.model)
        largest = max(self.library.get_vocab(with_added_tokens=True).values())
        self.width = 2 if largest < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        # tokens that begin with a blank, which stands as this letter in byte-level vocabularies
        self.leads = np.zeros(largest + 1, bool)
        self.leads[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t[0] == "Ġ"]] = True
        self.limit = remembered
        # stretches and their packed ids, by what stands before a stretch: nothing or a blank
        nothing = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.known = {"": nothing, " ": nothing}
        self.marks = pa.array([*MARKS], pa.large_string())
        self.mark_ids = self._whole([*MARKS])

    def _whole(self, stretches):
        """Packed ids of strings, each through the whole library."""
        coded = self.library.encode_batch_fast(stretches, add_special_tokens=False)
        return pa.array([np.array(c.ids, self.kind).tobytes() for c in coded], pa.large_binary())

    def _merged(self, stretches):
        """Packed ids of stretches that follow a blank, a line each: the first token begins with the blank, the last ends the line."""
        parts = []
        offsets = pa.array([*range(0, len(stretches), JOINED), len(stretches)], pa.int64())
        lines = pc.binary_join(pa.LargeListArray.from_arrays(offsets, stretches), pa.scalar("\n ", pa.large_string()))
        for line in lines.to_pylist():
            shown = self.letters[np.frombuffer(f" {line}\n".encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self.kind)
            begin = np.flatnonzero(self.leads[ids])
            inside = np.ones(len(ids), bool)
            inside[np.append(begin[1:], len(ids)) - 1] = False
            ends = np.append(begin - np.arange(len(begin)), inside.sum()) * self.width
            buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids[inside])]
            parts.append(pa.Array.from_buffers(pa.large_binary(), len(begin), buffers))
        return parts

    def _learn(self, stretches, lead):
        """Packed ids of new stretches."""
        straight = pc.match_substring_regex(stretches, _STRAIGHT) if lead and self.apart else pa.array(np.zeros(len(stretches), bool))
        others = stretches.filter(pc.invert(straight)).to_pylist()
        made = pa.concat_arrays([*self._merged(stretches.filter(straight)), self._whole([lead + s for s in others])])
        straight = straight.to_numpy(zero_copy_only=False)
        at = np.empty(len(stretches), np.int64)
        at[np.append(np.flatnonzero(straight), np.flatnonzero(~straight))] = np.arange(len(made))
        return made.take(pa.array(at))

    def _packed(self, stretches, lead):
        """Packed ids of stretches behind one kind of lead; new ones are learned."""
        coded = stretches.dictionary_encode()
        known, ids = self.known[lead]
        found = pc.index_in(coded.dictionary, value_set=known)
        new = coded.dictionary.filter(found.is_null())
        at = found.fill_null(0).to_numpy().astype(np.int64)
        at[found.is_null().to_numpy(zero_copy_only=False)] = len(known) + np.arange(len(new))
        room = known.nbytes + ids.nbytes < self.limit
        ids = pa.concat_arrays([ids, self._learn(new, lead)])
        if room:
            self.known[lead] = pa.concat_arrays([known, new]), ids
        return ids.take(pa.array(at[coded.indices.to_numpy()]))

    def _without_marks(self, words):
        """Packed ids of words that follow a blank: a mark behind letters is coded by itself."""
        marked = pc.match_substring_regex(words, _MARKED)
        bare, ended = words.filter(pc.invert(marked)), words.filter(marked)
        stems = pc.utf8_slice_codeunits(ended, 0, -1)
        ids = self._packed(pa.concat_arrays([bare, stems]), " ")
        marks = self.mark_ids.take(pc.index_in(pc.utf8_slice_codeunits(ended, -1), value_set=self.marks))
        joined = pc.binary_join_element_wise(ids[len(bare) :], marks, pa.scalar(b"", pa.large_binary()))
        marked = marked.to_numpy(zero_copy_only=False)
        at = np.empty(len(words), np.int64)
        at[np.append(np.flatnonzero(~marked), np.flatnonzero(marked))] = np.arange(len(words))
        return pa.concat_arrays([ids[: len(bare)], joined]).take(pa.array(at))

    def _cut_at_blanks(self, texts):
        """Packed ids of texts that can be cut at every blank."""
        words = pc.split_pattern(texts, " ")
        begin, coded = words.offsets.to_numpy()[:-1], words.values.dictionary_encode()
        later, first = self._without_marks(coded.dictionary), self._packed(words.values.take(pa.array(begin)), "")
        at = coded.indices.to_numpy().astype(np.int64)
        at[begin] = len(later) + np.arange(len(first))
        ids = pa.concat_arrays([later, first]).take(pa.array(at))
        lists = pa.LargeListArray.from_arrays(words.offsets.cast(pa.int64()), ids)
        return pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).to_pylist()

    def _stretches(self, text: str):
        """(lead, stretch) of a text that cannot simply be cut at every blank."""
        for part in self.specials.split(text) if self.specials else [text]:
            for stretch in _CUT.split(part) if _INSIDE.search(part) else _BLANK.split(part):
                if stretch.startswith(" "):
                    yield " ", stretch[1:]
                elif stretch:
                    yield "", stretch

    def _cut_with_care(self, texts):
        """Packed ids of texts with special tokens or blanks beside white space."""
        of, leads, stretches = [], [], []
        for k, text in enumerate(texts):
            for lead, stretch in self._stretches(text):
                of.append(k)
                leads.append(lead)
                stretches.append(stretch)
        stretches, blank = pa.array(stretches, pa.large_string()), pa.array([lead == " " for lead in leads], pa.bool_())
        coded = {lead: iter(self._packed(stretches.filter(pc.equal(blank, lead == " ")), lead).to_pylist()) for lead in self.known}
        out = [[] for _ in texts]
        for k, lead in zip(of, leads):
            out[k].append(next(coded[lead]))
        return [b"".join(ids) for ids in out]

    def encode(self, texts):
        """Packed ids of every text (bytes of UTF-8)."""
        whole = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        care = pc.match_substring_regex(whole, _CARE)
        for head in self.heads:
            care = pc.or_(care, pc.match_substring(whole, head))
        cut = iter(self._cut_at_blanks(whole.filter(pc.invert(care))))
        careful = iter(self._cut_with_care(whole.filter(care).to_pylist()))
        return [next(careful if c else cut) for c in care.to_pylist()]
