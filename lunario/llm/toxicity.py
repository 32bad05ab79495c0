"""Toxicity by a learned lexicon, misspellings and context windows.

Words that the labels tie to toxic documents become a lexicon. A trie of it is
intersected with the Levenshtein automaton of each distinct word of a batch
(``fuzzy_lexicon``), so misspelled and inflected forms are caught; near words
that clean documents use are known and left out. Every hit weighs by how telling
its term is and how far its spelling is off, and by a window of characters
around it: inside quotation marks it counts a quarter. A logistic curve over the
sum, and over the sum by length, gives the score; a text without hits is never
predicted toxic, however many labels are.

Learned are labels of at most ``SAMPLE`` rows a class, those with the smallest
hash of doc_id, and only from rows outside the held-out fold. Word counts of the
sample are summed over the cluster; the driver gets the lexicon (as many terms as
the words of the sample bear out), its near clean words and two numbers a sampled
row. All terms are looked for with edits. Inflected forms that share a beginning
add it as a stem, which stands for forms that the sample lacks.

What passes for a term is measured by the labels at hand: of the words with as
much evidence (log likelihood ratio) as a term has, fewer than ``CHANCE`` may be
expected if labels were dealt by chance, and its weight, the smoothed log odds,
shrinks by that share. Copies count once: equal texts are one text, and a word has
as many toxic documents as surroundings it stands in there, at most.

Defined results: null and empty texts have no hits and the lowest score. A null
doc_id is not held out. Repeated rows stay, one result row each; a doc_id with
two labels counts as toxic. Without labels every score is 0 and nothing is
predicted toxic. An empty table gives an empty result. Other columns are not
looked at.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.llm.common import bucket_of, in_worker, learning_labels, values, written
from lunario.llm.fuzzy_lexicon import STEM, FuzzyLexicon

FOLDS, HELD_OUT = 5, 0
SAMPLE = 20_000
STEM_SIZES = (4, 5, 6)
LEAST_FORMS = 4
STEM_CLEAN = 0.02
CHANCE = 0.5
LEAST_TELLING = 3.0
KNOWN_CLEAN = 2
CONTEXT = 120
QUOTED = 0.25
WITHOUT_HITS = -1.0
RISE_WITHOUT_FIT = 1.0
PER_EDIT = 0.6
REMEMBERED = 200_000
WORD = re.compile(r"\w+")
MARKS = [("“", "”"), ("«", "»"), ("„", "“"), ("‘", "’"), ('"', '"')]


def in_quotation(text, a, b):
    """Whether text[a:b] stands between quotation marks of one pair within the window around it."""
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    for opening, closing in MARKS:
        if closing in after:
            if opening == closing:
                line = before.rpartition("\n")[2]
                if line.count(opening) % 2:
                    return True
            elif before.rfind(opening) > before.rfind(closing):
                return True
    return False


class Evidence:
    """Sums up the hits of a text; remembers words it has met."""

    def __init__(self, weights, clean):
        self.lexicon, self.clean, self.known = FuzzyLexicon(weights), frozenset(clean), {}

    def _weigh(self, word):
        found = None if word in self.clean else self.lexicon.nearest(word)
        return self.lexicon.weights[found[0]] * PER_EDIT ** found[1] if found else 0.0

    def of(self, text):
        """(evidence, number of words)"""
        low = text.lower()
        words = WORD.findall(low)
        distinct = set(words)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in distinct.difference(known):
            known[word] = self._weigh(word)
        hits = {w for w in distinct if known[w]}
        if not hits:
            return 0.0, len(words)
        total = 0.0
        for match in WORD.finditer(low):
            if match[0] in hits:
                total += known[match[0]] * (QUOTED if in_quotation(low, *match.span()) else 1.0)
        return total, len(words)


def _evidence(shared):
    """The evidence of a broadcast lexicon, once per worker process."""
    lexicon = shared.value
    return in_worker(("toxicity", lexicon["key"]), lambda: Evidence(lexicon["weights"], lexicon["clean"]))


def features(text: str, evidence: Evidence):
    total, words = evidence.of(text)
    return math.log1p(total), math.log1p(100.0 * total / max(words, 1))


def _word_counts(batches):
    from collections import Counter

    seen = [Counter(), Counter()]

    def rows():
        words = list(seen[0].keys() | seen[1].keys())
        columns = [words, [seen[1][w] for w in words], [seen[0][w] for w in words]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["word", "toxic", "clean"])

    in_worker("word counts", dict)  # what earlier stages have left in this worker goes
    for batch in batches:
        for text, label in zip(values(batch.column(0)), batch.column(1).to_pylist()):
            seen[label].update(set(WORD.findall((text or "").lower())))
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield rows()
                seen[0].clear()
                seen[1].clear()
    yield rows()


def labelled_sample(docs: DataFrame, labels: DataFrame, name, fold, folds, sample=SAMPLE):
    """(text, label) of at most ``sample`` rows a class outside ``fold``, and the rows of each class there are."""
    usable = written(learning_labels(labels, name).where(bucket_of(F.col("doc_id"), folds) != fold), "labels")
    totals = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    by_hash = F.xxhash64("doc_id")
    parts = [usable.where(F.col("label") == k).orderBy(by_hash, "doc_id").limit(sample) for k in (0, 1)]
    # at most 2 * sample rows of two numbers
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "label")
    return written(rows, "labelled"), [totals.get(0, 0), totals.get(1, 0)]


def logistic_fit(x, y, weight, ridge=1e-2, rounds=60):
    """Weights of a ridge logistic regression (last column of x: ones), by damped Newton steps."""
    weight = weight / weight.sum() * len(y)

    def loss(w):
        return (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + ridge / 2 * w @ w

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, now = np.linalg.solve(bend, slope), loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _context_counts(texts, terms):
    """In how many different surroundings (word before, word after) each term stands; copies of a text add none."""

    def met(batches):
        for batch in batches:
            found = set()
            for text in values(batch.column(0)):
                words = ["", *WORD.findall((text or "").lower()), ""]
                found.update((w, a + " " + b) for a, w, b in zip(words, words[1:], words[2:]) if w in terms)
            term, around = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(around, pa.string())], ["term", "around"])

    pairs = texts.mapInArrow(met, "term string, around string").distinct()
    return dict(pairs.groupBy("term").count().collect())


def _with_stems(counts, weights, n_toxic, n_clean):
    """``weights`` and the stems of its terms. All forms stay, so that edits reach them.

    A stem is a beginning that at least
    LEAST_FORMS terms share and that is rare in words of clean documents.
    """
    forms = {}
    for term in weights:
        for size in STEM_SIZES:
            if len(term) > size:
                forms.setdefault(term[:size], []).append(term)
    # of beginnings with the same terms the longest says most
    longest = {tuple(terms): stem for stem, terms in sorted(forms.items(), key=lambda f: len(f[0]))}
    asked = [stem for terms, stem in longest.items() if len(terms) >= LEAST_FORMS]
    stems = {}
    for size in STEM_SIZES:
        begins = F.substring("word", 1, size)
        of_size = [stem for stem in asked if len(stem) == size]
        if of_size:
            used = counts.select(begins.alias("stem"), "toxic", "clean").where(F.col("stem").isin(of_size))
            for stem, toxic, clean in used.groupBy("stem").agg(F.sum("toxic"), F.sum("clean")).collect():
                toxic, clean = (toxic + 0.5) / (n_toxic + 1.0), (clean + 0.5) / (n_clean + 1.0)
                if clean <= STEM_CLEAN * toxic and not any(stem[:k] in stems for k in STEM_SIZES):
                    stems[stem] = min(math.log(toxic / clean), max(weights[t] for t in forms[stem]))
    return weights | {stem + STEM: w for stem, w in stems.items()}


def _gain(toxic, clean, rate):
    """Log likelihood ratio of a word's own share of toxic documents against ``rate``; 0 for shares up to it."""
    toxic, clean = np.asarray(toxic, float), np.asarray(clean, float)
    n = np.maximum(toxic + clean, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.where(toxic > 0, toxic * np.log(toxic / (n * rate)), 0.0)
        found += np.where(clean > 0, clean * np.log(clean / (n * (1 - rate))), 0.0)
    return np.where(toxic > n * rate, found, 0.0)


def _expected_by_chance(gains, sizes, rate):
    """How many words reach each of ``gains``, or more, if each document is toxic with chance ``rate``.

    ``sizes``: number of words by number of documents. The gain of a word of n
    documents rises with the toxic ones, so a binomial tail answers each question;
    n is bounded by the labelled sample.
    """
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, max(sizes) + 1)))])
    asked, place = np.unique(gains, return_inverse=True)
    expected = np.zeros(len(asked))
    for n, words in sizes.items():
        toxic = np.arange(n + 1)
        chance = np.exp(logs[n] - logs[toxic] - logs[n - toxic] + toxic * math.log(rate) + (n - toxic) * math.log1p(-rate))
        tail = np.append(np.cumsum(chance[::-1])[::-1], 0.0)
        expected += words * tail[np.searchsorted(_gain(toxic, n - toxic, rate), asked - 1e-9)]
    return expected[place]


def chance_shares(toxic, clean, sizes, rate):
    """For each word (toxic and clean documents) the share of chance words among those with its gain or more."""
    gain = _gain(toxic, clean, rate)
    order = np.argsort(-gain, kind="stable")
    falling = gain[order]
    # words of equal gain are found together
    found = np.searchsorted(-falling, -falling + 1e-9, side="right")
    share = np.minimum(_expected_by_chance(falling, sizes, rate) / np.maximum(found, 1), 1.0)
    out = np.empty(len(gain))
    # a word is no worse than one with less gain
    out[order] = np.minimum.accumulate(share[::-1])[::-1]
    return out


def telling_words(counts, texts, n_toxic, n_clean):
    """Weights of the terms: words of toxic documents with more evidence than chance gives."""
    rate = n_toxic / (n_toxic + n_clean)

    def odds(toxic, clean):
        return math.log((toxic + 0.5) / (n_toxic + 1.0)) - math.log((clean + 0.5) / (n_clean + 1.0))

    # the different counts of words, not the words
    tally = [tuple(r) for r in counts.groupBy("toxic", "clean").count().collect()]
    sizes = {}
    for toxic, clean, words in tally:
        sizes[toxic + clean] = sizes.get(toxic + clean, 0) + words
    kinds = [(t, c, w) for t, c, w in tally if t and odds(t, c) > LEAST_TELLING]
    if not kinds:
        return {}
    toxic, clean, words = (np.array(v) for v in zip(*kinds))
    share = chance_shares(np.repeat(toxic, words), np.repeat(clean, words), sizes, rate)
    first = np.cumsum(words) - words
    passing = [(int(t), int(c)) for t, c, i in zip(toxic, clean, first) if share[i] < CHANCE]
    if not passing:
        return {}
    few = F.broadcast(counts.sparkSession.createDataFrame(passing, "toxic long, clean long"))
    rows = counts.join(few, ["toxic", "clean"]).select("word", "toxic", "clean").collect()
    varied = _context_counts(texts, {r["word"] for r in rows})
    rows = [(r["word"], min(r["toxic"], varied.get(r["word"], 0)), r["clean"]) for r in rows]
    rows = sorted(r for r in rows if r[1] and odds(*r[1:]) > LEAST_TELLING)
    if not rows:
        return {}
    share = chance_shares(*(np.array(v) for v in list(zip(*rows))[1:]), sizes, rate)
    return {w: odds(t, c) * (1.0 - float(q)) for (w, t, c), q in zip(rows, share) if q < CHANCE}


def fitted_curve(x, y, weight):
    """[a, b, base] of the logistic curve, which never falls with the evidence.

    Where the few hits of the sample give no rise, any whole hit is enough.
    """
    a, b, base = logistic_fit(x, y, weight).tolist()
    if a < 0 or b < 0:
        one = 1 if a < 0 else 0
        rise, base = logistic_fit(x[:, [one, 2]], y, weight).tolist()
        a, b = (rise, 0.0) if one == 0 else (0.0, rise)
    base = min(base, WITHOUT_HITS)
    if max(a, b) <= 0:
        a, b, base = RISE_WITHOUT_FIT, 0.0, WITHOUT_HITS
    return [a, b, base]


class ToxicityModel:
    """Lexicon, near clean words and curve, fitted on labelled documents."""

    def __init__(self, spark, docs: DataFrame, labels: DataFrame):
        self.curve = None
        rows, totals = labelled_sample(docs, labels, "toxic", HELD_OUT, FOLDS)
        sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
        if not n_toxic or not n_clean:
            return
        # of equal texts one is counted
        single = written(rows.where("text is not null").groupBy("label", F.xxhash64("text").alias("copy")).agg(F.first("text").alias("text")), "texts")
        differing = {r["label"]: r["count"] for r in single.groupBy("label").count().collect()}
        different = [differing.get(k, 0) for k in (0, 1)]
        if not all(different):
            return
        counts = single.select("text", "label").mapInArrow(_word_counts, "word string, toxic long, clean long")
        counts = written(counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")
        weights = telling_words(counts, single.where("label = 1").select("text"), different[1], different[0])
        weights = _with_stems(counts, weights, different[1], different[0])
        first = spark.sparkContext.broadcast({"key": _key(), "weights": weights, "clean": []})

        @F.arrow_udf("boolean")
        def near(words: pa.Array) -> pa.Array:
            weigh = _evidence(first)._weigh
            return pa.array([bool(weigh(w)) for w in words.to_pylist()], pa.bool_())

        used = (F.col("clean") >= KNOWN_CLEAN) & (F.col("clean") * different[1] >= F.col("toxic") * different[0] * 0.2)
        clean = [r["word"] for r in counts.where(used & near("word")).select("word").collect()]
        self.shared = spark.sparkContext.broadcast({"key": _key(), "weights": weights, "clean": clean})
        got = rows.select("label", self._features("text").alias("x")).select("label", "x.*").collect()
        x = np.array([[r["a"], r["b"], 1.0] for r in got])
        y = np.array([r["label"] for r in got], float)
        share = np.array([max(t, 1) / max(s, 1) for t, s in zip(totals, (n_clean, n_toxic))])
        self.curve = fitted_curve(x, y, (share / share.max())[y.astype(int)])

    def _features(self, text):
        shared = self.shared

        @F.arrow_udf("struct<a: double, b: double>")
        def toxic_features(texts: pa.Array) -> pa.Array:
            evidence = _evidence(shared)
            found = np.array([features(t or "", evidence) for t in values(texts)]).reshape(-1, 2)
            return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        return toxic_features(text)

    def score(self, text):
        """Score column between 0 and 1 of a text column."""
        if self.curve is None:
            return F.lit(0.0)
        shared, curve = self.shared, self.curve

        @F.arrow_udf("double")
        def toxicity(texts: pa.Array) -> pa.Array:
            evidence = _evidence(shared)
            found = np.array([features(t or "", evidence) for t in values(texts)]).reshape(-1, 2)
            return pa.array(1 / (1 + np.exp(-np.clip(found @ curve[:2] + curve[2], -30, 30))))

        return toxicity(text)


def _key():
    import uuid

    return uuid.uuid4().hex


def op7_levenshtein_toxicity(spark, sf_dir):
    """Contract query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ToxicityModel(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def civil_documents(spark, docs, sf_dir):
    """Pipeline stage: documents predicted toxic go; all others stay as they are."""
    model = ToxicityModel(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.score(docs["text"]) < 0.5)
