"""Minimal acyclic transducer from words to token ids.

Words are added in sorted order; as soon as a suffix can no longer change, its
state is replaced by an equal one that exists (shared suffixes). Every arc
carries an output, the number of words that sort before all words behind it, so
the outputs along a word sum to its rank, and the rank addresses the ids. The
tables are laid out one after the other in one file that tasks map into memory;
looking up many words walks all of them in step, one byte at a time.
"""

import numpy as np

MAGIC = b"LXT1"
FIELDS = [("arcs", "<u8"), ("target", "<u4"), ("output", "<u4"), ("final", "u1"), ("offset", "<u4"), ("ids", "<u4")]


class _Builder:
    def __init__(self):
        self.arcs, self.final, self.register = [{}], [False], {}
        self.path = []  # (parent, byte) of the last word's states that are not yet shared

    def _share(self, keep):
        while len(self.path) > keep:
            parent, byte = self.path.pop()
            state = self.arcs[parent][byte]
            key = (self.final[state], tuple(self.arcs[state].items()))
            self.arcs[parent][byte] = self.register.setdefault(key, state)

    def add(self, word, common):
        self._share(common)
        state = self.arcs[self.path[-1][0]][self.path[-1][1]] if self.path else 0
        for byte in word[common:]:
            self.arcs.append({})
            self.final.append(False)
            self.arcs[state][byte] = len(self.arcs) - 1
            self.path.append((state, byte))
            state = len(self.arcs) - 1
        self.final[state] = True


def compiled(entries) -> bytes:
    """The file of a lexicon; ``entries``: (word as bytes, ids), each word once."""
    entries = sorted(entries)
    build, last = _Builder(), b""
    for word, _ in entries:
        common = next((i for i, (x, y) in enumerate(zip(word, last)) if x != y), min(len(word), len(last)))
        build.add(word, common)
        last = word
    build._share(0)

    number, order, below = {}, [], {}

    def words_below(top):
        stack = [top]
        while stack:
            state = stack[-1]
            open_ones = [t for t in build.arcs[state].values() if t not in below]
            if open_ones:
                stack += open_ones
                continue
            stack.pop()
            below[state] = build.final[state] + sum(below[t] for t in build.arcs[state].values())

    words_below(0)
    seen = [0]
    while seen:
        state = seen.pop()
        if state not in number:
            number[state] = len(order)
            order.append(state)
            seen += build.arcs[state].values()
    arcs, target, output = [], [], []
    for state in order:
        before = int(build.final[state])
        for byte, to in sorted(build.arcs[state].items()):
            arcs.append(number[state] << 8 | byte)
            target.append(number[to])
            output.append(before)
            before += below[to]
    lengths = [len(ids) for _, ids in entries]
    parts = {
        "arcs": arcs,
        "target": target,
        "output": output,
        "final": [build.final[s] for s in order],
        "offset": np.concatenate([[0], np.cumsum(lengths)]) if entries else [0],
        "ids": [i for _, ids in entries for i in ids],
    }
    tables = [np.asarray(parts[name], kind) for name, kind in FIELDS]
    head = np.array([len(t) for t in tables], "<u8").tobytes()
    padded = [t.tobytes() + b"\0" * (-t.nbytes % 8) for t in tables]
    return MAGIC + b"\0" * 4 + head + b"".join(padded)


class Transducer:
    """A compiled lexicon over a buffer, usually a memory-mapped file."""

    def __init__(self, buffer):
        view = memoryview(buffer)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a compiled lexicon")
        counts = np.frombuffer(view, "<u8", len(FIELDS), 8)
        at = 8 + counts.nbytes
        for (name, kind), count in zip(FIELDS, counts.tolist()):
            part = np.frombuffer(view, kind, count, at)
            setattr(self, name, part)
            at += part.nbytes + -part.nbytes % 8

    def ranks(self, words):
        """Rank of every word (bytes), -1 where the lexicon lacks it."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        text = np.frombuffer(b"".join(words), np.uint8)
        rank = np.zeros(len(words), np.int64)
        state = np.zeros(len(words), np.int64)
        if not len(self.arcs):
            return np.where((lengths == 0) & bool(len(self.final) and self.final[0]), 0, -1)
        live, step = np.flatnonzero(lengths > 0), 0
        while len(live):
            wanted = (state[live] << 8 | text[starts[live] + step]).astype(np.uint64)
            arc = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            found = self.arcs[arc] == wanted
            state[live[~found]] = -1
            live, arc = live[found], arc[found]
            rank[live] += self.output[arc]
            state[live] = self.target[arc]
            step += 1
            live = live[lengths[live] > step]
        known = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(known, rank, -1)

    def ids_of(self, rank):
        return self.ids[self.offset[rank] : self.offset[rank + 1]]
