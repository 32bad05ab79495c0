"""A lexicon trie and its intersection with the Levenshtein automaton of a word.

The automaton of a word is kept as bit sets: bit i of ``rows[e]`` says that the
letters read so far match the first i letters of the word with e edits. Walking
down the trie feeds it one letter at a time, and a branch ends as soon as all
sets are empty. How many edits a term allows depends on its length.

With e edits at least one of e + 1 parts of a term stays whole, so a word is only
walked down the tries of the terms that share such a part with it. Each of these
tries is built when a word first asks for it.
"""


def edits_for(length: int) -> int:
    """Short terms only as they are, one edit from four letters on, two from nine."""
    return 0 if length < 4 else 1 if length < 9 else 2


STEM = "*"


class FuzzyLexicon:
    """Terms with weights; finds the nearest term of a word within the term's edits.

    A term that ends in ``*`` is a stem: it stands for every word that begins
    with it, as written, and that is not near a term.
    """

    def __init__(self, weights: dict):
        self.weights = weights
        stems = {t[:-1] for t in weights if t.endswith(STEM)}
        self.stems, self.stem_sizes = stems, sorted({len(t) for t in stems})
        weights = {t: w for t, w in weights.items() if not t.endswith(STEM)}
        self.parts, self.tries = {}, {}
        for term in weights:
            self._note_parts(term)
        self.shapes = sorted(self.parts)
        self.longest = max((len(t) + edits_for(len(t)) for t in weights), default=0)

    def _note_parts(self, term):
        """The parts of a term, each wherever e edits may move it."""
        e, m = edits_for(len(term)), len(term)
        cuts = [k * m // (e + 1) for k in range(e + 2)]
        for a, b in zip(cuts, cuts[1:]):
            for moved in range(-e, e + 1):
                if a + moved >= 0 and not (a == 0 and moved) and not (b == m and moved):
                    # the last part is counted from the end, where no place before it matters
                    shape = (a - m, b - m) if b == m and a else (a + moved, b + moved)
                    self.parts.setdefault(shape, {}).setdefault(term[a:b], []).append(term)

    def _tries(self, word):
        """The tries of the terms that share a part with the word."""
        for shape in self.shapes:
            a, b = shape
            part = word[a:] if b == 0 else word[a:b]
            terms = self.parts[shape].get(part)
            if terms:
                root = self.tries.get((shape, part))
                if root is None:
                    root = self.tries[shape, part] = {}
                    for term in terms:
                        node = root
                        for letter in term:
                            node = node.setdefault(letter, {})
                        node[None] = term
                yield root

    def nearest(self, word: str):
        """(term, edits) with the fewest edits, ties to the heavier and then smaller term; None if none is near."""
        if word in self.weights:
            return word, 0
        return self._walk(word) or self._stem_of(word)

    def _stem_of(self, word):
        for size in self.stem_sizes:
            if word[:size] in self.stems:
                return word[:size] + STEM, 0
        return None

    def _walk(self, word):
        if len(word) > self.longest:
            return None
        roots = list(self._tries(word))
        if not roots:
            return None
        places = {}
        for i, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << i
        whole, full = 1 << len(word), (2 << len(word)) - 1
        best = None
        stack = [(root, 1, 3 & full, 7 & full) for root in roots]
        while stack:
            node, r0, r1, r2 = stack.pop()
            for letter, below in node.items():
                if letter is None:
                    edits = 0 if r0 & whole else 1 if r1 & whole else 2 if r2 & whole else 3
                    if edits <= edits_for(len(below)):
                        found = (edits, -self.weights[below], below)
                        best = found if best is None else min(best, found)
                    continue
                at = places.get(letter, 0)
                n0 = (r0 & at) << 1
                n1 = (r1 & at) << 1 | r0 << 1 | r0 | n0 << 1
                n2 = (r2 & at) << 1 | r1 << 1 | r1 | n1 << 1
                n0, n1, n2 = n0 & full, n1 & full, n2 & full
                if n0 | n1 | n2:
                    stack.append((below, n0, n1, n2))
        return None if best is None else (best[2], best[0])
