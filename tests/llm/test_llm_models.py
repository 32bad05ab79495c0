"""Toxicity, quality and language on held-out rows and on edge cases; the fuzzy lexicon against edit distance."""

import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from llmdata import SF_DIR
from lunario.llm import language
from lunario.llm.fuzzy_lexicon import FuzzyLexicon, edits_for
from lunario.llm.language import LanguageProfiles, grams, op9_rank_order_language
from lunario.llm.quality import QualityModel, kth_largest, ngram_buckets, op5_importance_resampling
from lunario.llm.toxicity import Evidence, ToxicityModel, fitted_curve, in_quotation, op7_levenshtein_toxicity

WIDE = "/root/testdata/sf0.1"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last = [i + 1]
        for j, y in enumerate(b):
            last.append(min(row[j] + (x != y), row[j + 1] + 1, last[j] + 1))
        row = last
    return row[-1]


def test_nearest_term_equals_edit_distance():
    draw = random.Random(3)
    terms = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 12))): draw.random() for _ in range(40)}
    lexicon = FuzzyLexicon(terms)
    for _ in range(4000):
        word = list(draw.choice([*terms, "abcabc"]))
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(word))
            word[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "d"])
        word = "".join(word)
        near = [(edits(word, t), -terms[t], t) for t in terms if edits(word, t) <= edits_for(len(t))]
        expected = (word, 0) if word in terms else (min(near)[2], min(near)[0]) if near else None
        assert lexicon.nearest(word) == expected


def test_quotation_counts_less():
    evidence = Evidence({"moron": 5.0}, ["moran"])
    plain, quoted = evidence.of("you moron go"), evidence.of('they said "you moron" and left')
    assert plain[0] == 5.0 and quoted[0] == 1.25
    assert 0 < evidence.of("you morron")[0] < 5.0
    assert evidence.of("captain moran")[0] == 0
    assert in_quotation("« un moron »", 5, 10) and not in_quotation('he said "no" moron', 13, 18)


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{WIDE}/labels.parquet")
    rows = op7_levenshtein_toxicity(spark, WIDE).where("held_out").join(labels, "doc_id").collect()
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert sum(right) / len(right) > 0.97
    caught = [r["predicted"] for r in rows if r["toxic"]]
    assert sum(caught) / len(caught) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def _labelled(spark, toxic, clean):
    """Documents and labels of these texts."""
    rows = [(i, text, int(i < len(toxic))) for i, text in enumerate(toxic + clean)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return table.select("doc_id", "text"), table.select("doc_id", "toxic")


def _invented(draw, least=6, most=11):
    return "".join(draw.choice("abcdefghijklmnoprstuvz") for _ in range(draw.randint(least, most)))


def test_every_term_of_a_large_lexicon_is_matched(spark):
    draw = random.Random(5)
    terms = sorted({_invented(draw) for _ in range(400)})
    plain = sorted({_invented(draw) for _ in range(300)} - set(terms))

    def around(term):
        return f"{draw.choice(plain)} {term} {draw.choice(plain)}"

    docs, labels = _labelled(
        spark,
        [" ".join(around(t) for t in draw.sample(terms, 40)) for _ in range(400)],
        [" ".join(draw.choices(plain, k=120)) for _ in range(400)],
    )
    weights = ToxicityModel(spark, docs, labels).shared.value["weights"]
    lexicon = FuzzyLexicon(weights)
    assert all(lexicon.nearest(t) for t in terms)
    assert all(lexicon.nearest(t[:3] + "y" + t[4:]) for t in terms)


def test_stemmed_forms_are_matched_with_edits(spark):
    draw = random.Random(6)
    forms = ["vermont" + end for end in ("elo", "isch", "ade", "urno", "ilka")]
    plain = sorted({_invented(draw) for _ in range(200)})
    docs, labels = _labelled(
        spark,
        [" ".join(f"{draw.choice(plain)} {f} {draw.choice(plain)}" for f in draw.sample(forms, 3)) for _ in range(120)],
        [" ".join(draw.choices(plain, k=40)) for _ in range(120)],
    )
    model = ToxicityModel(spark, docs, labels)
    lexicon = FuzzyLexicon(model.shared.value["weights"])
    assert set(forms) <= set(lexicon.weights) and lexicon.stems
    # a misspelling inside the stem, one behind it, and a form not in the sample
    assert lexicon.nearest("vexmontisch") == ("vermontisch", 1)
    assert lexicon.nearest("vermontixch") == ("vermontisch", 1)
    assert lexicon.nearest("vermontagnard")[0].endswith("*")


def test_toxicity_of_few_labels(spark):
    """68 learning labels, 10 of them toxic."""
    small = "/root/testdata/sf0.001"
    rows = op7_levenshtein_toxicity(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").collect()
    caught = [r["predicted"] for r in rows if r["toxic"]]
    assert sum(caught) / len(caught) > 0.5
    assert not any(r["predicted"] for r in rows if r["toxic"] == 0)


def test_rare_terms_count_and_copies_do_not(spark):
    draw = random.Random(7)
    plain = sorted({_invented(draw) for _ in range(60)})
    rare, copied = "grumblork", "copied wistful phrase"

    def text(*more):
        return " ".join([*draw.choices(plain, k=20), *more, *draw.choices(plain, k=20)])

    same = text(copied)
    # six documents hold the rare term; one text stands eight times
    toxic = [text(rare) for _ in range(6)] + [same] * 8
    docs, labels = _labelled(spark, toxic, [text() for _ in range(60)])
    weights = ToxicityModel(spark, docs, labels).shared.value["weights"]
    assert rare in weights
    assert not set(copied.split()) & set(weights)


def test_curve_never_falls_with_the_evidence():
    x = np.array([[2.0, 1.0, 1.0], [2.5, 0.5, 1.0], [0.0, 0.0, 1.0], [1.0, 2.0, 1.0], [0.0, 0.0, 1.0]])
    a, b, _ = fitted_curve(x, np.array([1.0, 1.0, 0.0, 0.0, 0.0]), np.ones(5))
    assert a > 0 and b >= 0
    a, b, base = fitted_curve(x, np.array([0.0, 0.0, 1.0, 0.0, 1.0]), np.ones(5))
    assert a > 0 and b >= 0 and base < 0


def test_toxicity_without_labels(spark, edge, edge_dir):
    labels = spark.read.parquet(f"{edge_dir}/empty/labels.parquet")
    scores = edge.select(ToxicityModel(spark, edge, labels).score(edge["text"]).alias("s")).collect()
    assert {r["s"] for r in scores} == {0.0}


def test_quality_on_labelled_rows(spark):
    labels = spark.read.parquet(f"{WIDE}/labels.parquet")
    rows = op5_importance_resampling(spark, WIDE).join(labels, "doc_id").collect()
    good = [r["selected"] for r in rows if r["quality"] == 1]
    bad = [r["selected"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99
    assert sum(bad) / len(bad) < 0.05


def test_sample_takes_exactly_the_k_largest_keys(spark, documents):
    model = QualityModel(spark, documents, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = model.sampled(documents, 100).collect()
    keys = sorted((r["key"] for r in rows if r["n_grams"]), reverse=True)
    assert {r["key"] for r in rows if r["selected"]} == {k for k in keys if k >= keys[99]}
    assert not any(r["selected"] for r in model.sampled(documents, 0).collect())


def test_kth_largest_with_ties_and_tails(spark):
    draw = random.Random(4)
    values = [draw.choice([0.0, 1.0, draw.gauss(0, 1), draw.gauss(0, 1e6), 1e-300]) for _ in range(3000)]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert kth_largest(keys, k) == ordered[k - 1]
    assert kth_largest(keys, 3001) is None and kth_largest(keys, 0) is None
    assert kth_largest(keys.where("false"), 1) is None


def test_ngrams_of_empty_and_repeated_text():
    assert len(ngram_buckets("")) == 0
    assert len(ngram_buckets("one")) == 1
    # two words, a pair, and that the word repeats
    assert len(ngram_buckets("one one")) == 4


def test_quality_without_labels(spark, edge, edge_dir):
    model = QualityModel(spark, edge, spark.read.parquet(f"{edge_dir}/empty/labels.parquet"))
    rows = model.sampled(edge).collect()
    assert all(r["selected"] == (r["n_grams"] > 0) for r in rows)


def test_language_on_held_out_rows(spark, documents):
    found = op9_rank_order_language(spark, SF_DIR).join(documents.select("doc_id", "lang"), "doc_id")
    rows = found.where(F.col("held_out")).collect()
    assert rows
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_language_of_odd_texts(spark, edge_dir):
    rows = op9_rank_order_language(spark, f"{edge_dir}/full").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = [r for r in rows if r["doc_id"] in (2, 3, 6, 7)]
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_profiles_by_hand():
    a, b = (grams(w)[0] for w in ("aaab", "cccd"))
    profiles = LanguageProfiles({"x": a.tolist(), "y": b.tolist()})
    assert profiles.nearest("aaab")[0] == "x" and profiles.nearest("CCCD")[0] == "y"
    assert profiles.nearest("123") == ("und", 0.0)
    # nothing shared with either: a tie goes to the smaller name
    assert profiles.nearest("zzz") == ("x", 0.0)
    assert LanguageProfiles({}).nearest("abc") == ("und", 0.0)
    assert grams("ab")[1].sum() == 2 + 3 + 2


def plain_grams(text):
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
    padded = [f" {w} " for w in words]
    return Counter(p[i : i + n] for p in padded for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " ")


def test_languages_against_a_plain_version(spark):
    """Counts, ranks and distances gram by gram over a whole table, learned from the same rows."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.lang) for r in table.collect()]
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i, *_ in rows}
    learned = {}
    for i, text, lang in rows:
        if lang is not None and fold[i] != 2:
            learned.setdefault(lang, Counter()).update(plain_grams(text))

    def ranked(count):
        return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], code(x[0])))][:400]

    def code(gram):
        value = 0
        for c in gram:
            value = value << 21 | ord(c)
        return value

    places = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in learned.items()}
    found = {r.doc_id: r for r in op9_rank_order_language(spark, "/root/testdata/sf0.001").collect()}
    for i, text, _ in rows:
        mine = ranked(plain_grams(text))
        off = sorted((sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(mine)), lang) for lang, p in places.items())
        assert found[i].held_out == (fold[i] == 2)
        assert found[i].lang_pred == (off[0][1] if mine else "und")


def test_stretches_of_a_long_text(monkeypatch):
    text = "Añb x yz, 12 ½ δοκιμή " * 40
    whole = grams(text)
    monkeypatch.setattr(language, "STRETCH", 37)
    parts = grams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert dict(zip(whole[0].tolist(), whole[1].tolist())) == {
        sum(ord(c) << 21 * k for k, c in enumerate(reversed(g))): n for g, n in plain_grams(text).items()
    }


def test_numbers_are_not_letters():
    profiles = LanguageProfiles({"en": grams("the ½ house")[0].tolist()})
    assert profiles.nearest("½ ② ² Ⅷ 7_") == ("und", 0.0)