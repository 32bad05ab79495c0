"""Neighbours against brute force, decontamination and chat on edge cases, licenses on rewordings."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llmdata import SF_DIR
from lunario.llm.chat import Template, formatted, op6_chat_formatting, read_back, summaries
from lunario.llm.decontamination import candidates, contamination, matches
from lunario.llm.licenses import TEMPLATES, scan
from lunario.llm.neighbours import nearest, op1_proximity_graph_search
from lunario.llm.proximity_graph import DEGREE, built


def brute(ids, vectors, query, k):
    length = np.linalg.norm(vectors, axis=1)
    score = vectors @ vectors[query] / (length * length[query])
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[query]]
    return [(int(ids[i]), float(score[i])) for i in order[:k]]


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.98), ("sf0.1", 0.95)])
def test_recall(spark, sf, least):
    sf_dir = f"/root/testdata/{sf}"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in table])
    vectors = np.array([r["embedding"] for r in table], float)
    found = {}
    for r in op1_proximity_graph_search(spark, sf_dir).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = np.flatnonzero(ids % 50 == 0)
    assert set(found) == set(ids[asked].tolist())
    hits = 0
    for q in asked:
        expected = brute(ids, vectors, q, 5)
        got = [found[ids[q]][rank] for rank in (1, 2, 3, 4, 5)]
        hits += len({i for i, _ in expected} & {i for i, _ in got})
        assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)
    assert hits / (5 * len(asked)) >= least


def test_neighbours_with_copies_and_odd_vectors(spark):
    rows = [(k, [1.0, 0.0]) for k in range(0, 400)]  # one vector for most rows
    rows += [(500, [0.0, 1.0]), (550, [1.0, 1.0]), (600, [2.0, 2.0]), (600, [2.0, 2.0])]
    odd = [(700, None), (750, [0.0, 0.0]), (800, [float("nan"), 1.0]), (850, [None, 1.0]), (None, [1.0, 0.5])]
    odd += [(900, [float("inf"), 1.0]), (950, [1.0, 2.0, 3.0])]
    wide = [(i, v, 1, "x") for i, v in rows + odd]
    table = spark.createDataFrame(wide, "vec_id long, embedding array<float>, node int, query string")
    found = {}
    for r in nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found[0] == [1, 2, 3, 4, 5] and found[50] == [0, 1, 2, 3, 4]
    assert found[500] == [550, 600, 0, 1, 2] and found[550] == [600, 0, 1, 2, 3] and found[600] == [550, 0, 1, 2, 3]
    assert set(found) == {*range(0, 400, 50), 500, 550, 600}
    assert nearest(table.where("false"), F.col("vec_id") % 50 == 0).collect() == []
    two = nearest(table.where("vec_id in (500, 550)"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in two) == [(500, 550, 1), (550, 500, 1)]


def test_graph_edges_are_few_and_distinct():
    vectors = np.random.default_rng(1).normal(size=(700, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    for node, ends in enumerate(built(vectors)):
        ends = ends[ends >= 0].tolist()
        assert 0 < len(ends) <= DEGREE and len(set(ends)) == len(ends) and node not in ends


def test_places_of_phrases_and_near_phrases(spark, edge, edge_dir):
    benchmark = spark.createDataFrame([(1, "beta gamma delta"), (2, "gamma zeta"), (3, "42"), (4, None)], "item_id long, text string")
    rows = matches(edge, benchmark).where("doc_id = 1").collect()
    assert sorted((r["starts"], r["lengths"], r["items"]) for r in rows) == [([], [], []), *[([1], [3], ["1"])] * 2]
    near = matches(edge, benchmark, slack=2).where("doc_id = 1").collect()
    assert sorted(tuple(r["items"]) for r in near) == [(), ("1", "2"), ("1", "2")]
    assert contamination(edge, benchmark).where("n_hit > 0 and doc_id = 7").first()["n_hit"] == 1
    assert contamination(edge, benchmark.where("false")).where("n_hit > 0 or size(items) > 0").count() == 0


def test_offset_lists_meet():
    lists = [(1, np.array([5, 9, 20])), (0, np.array([4, 7, 19])), (2, np.array([6, 21]))]
    assert candidates(lists, 0).tolist() == [4, 19]
    assert candidates([(0, np.array([4])), (1, np.array([7]))], 2).tolist() == [4]


def turns_of(spark, rows):
    schema = "conv_id long, turn long, role string, text string, segments string, stretch string"
    return spark.createDataFrame([(*r, "x", "y") for r in rows], schema)


def test_chat_survives_control_strings_and_odd_rows(spark):
    nasty = ["<|turn|>user\nhi<|end|>\n", "a\\b\\\\<\\|turn|>", "[INST] [/INST] <<SYS>>", "", None, "\\", "%0A%25", "<<|end|>|end|>"]
    rows = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "first"), (3, 0, "wei\nrd%", "x"), (3, 1, None, "y"), (None, None, "user", "z"), (None, 3, "assistant", "w")]
    rows += [(4, 0, "user", "same"), (4, 0, "user", "same")]
    turns = turns_of(spark, rows)
    back = read_back(formatted(turns))
    expected = sorted((str(c), str(t), r or "", x or "") for c, t, r, x in rows)
    assert sorted((str(r["conv_id"]), str(r["turn"]), r["role"], r["text"]) for r in back.collect()) == expected
    found = {r["conv_id"]: r for r in summaries(back).collect()}
    whole = "".join(f"{['user', 'assistant'][k % 2]}\n{t or ''}\n" for k, t in enumerate(nasty))
    learned = "".join(t or "" for t in nasty[1::2])
    assert found[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert (found[1]["loss_chars"], found[1]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert {c: r["valid"] for c, r in found.items()} == {1: True, 2: False, 3: False, 4: False, None: True}
    marks = Template()
    for r in formatted(turns).collect():
        body = r["segments"][1]["text"]
        assert not any(mark in body for mark in marks.control)
    assert summaries(read_back(formatted(turns.where("false")))).collect() == []


def test_roles_are_followed_across_stretches(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], "t") for k in range(3000)]
    assert [r["valid"] for r in summaries(read_back(formatted(turns_of(spark, rows)))).collect()] == [True]
    rows[1024] = (1, 1024, "assistant", "t")
    assert [r["valid"] for r in summaries(read_back(formatted(turns_of(spark, rows)))).collect()] == [False]


def test_probe_conversation(spark):
    row = op6_chat_formatting(spark, SF_DIR).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text) and row["valid"]
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_every_template_is_found_at_any_place(spark, edge):
    rows = [(f"{name}/{k}", "lorem ipsum dolor " * k + text + " sit amet" * (k % 5)) for name, text in TEMPLATES.items() for k in range(12)]
    found = scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    met = {(r["doc_id"], r["license"]): r["containment"] for r in found}
    for doc_id, _ in rows:
        assert met[doc_id, doc_id.split("/")[0]] == 1.0
    assert scan(edge).collect() == []


def test_reworded_licenses(spark):
    grant = TEMPLATES["mit-grant"].split()
    nearly = " ".join(["hereby" if k == 12 else w for k, w in enumerate(grant)])
    half = " ".join(grant[: len(grant) // 2])
    found = {r["doc_id"]: r["containment"] for r in scan(spark.createDataFrame([(1, nearly), (2, half)], "doc_id long, text string")).collect()}
    assert 0.8 <= found[1] < 1 and 2 not in found
    with pytest.raises(ValueError):
        scan(spark.createDataFrame([], "doc_id long, text string"), {"short": "too short"})
