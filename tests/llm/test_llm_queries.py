"""The registered queries against their SQL, and on tables of edge cases and without rows."""

import pytest

from llmdata import SF_DIR
from lunario.llm.queries import ORACLES, QUERIES
from oracle import compare, connect

BY_DOCUMENT = [n for n in QUERIES if not n.startswith(("op1_", "op2_", "op6_", "op11_", "op12_", "op13_"))]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    problem, count = compare(spark, connect(SF_DIR), SF_DIR, QUERIES[name], ORACLES[name])
    assert problem is None
    assert count > 0


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_row_for_each_document(spark, edge_dir, edge, name):
    rows = QUERIES[name](spark, f"{edge_dir}/full").collect()
    assert len(rows) == edge.count()
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(r["doc_id"] or 0 for r in edge.collect())


@pytest.mark.parametrize("name", [*BY_DOCUMENT, "op2_minhash_license_scan", "op11_island_packing", "op12_pair_merge_divergence"])
def test_empty_tables(spark, edge_dir, name):
    assert QUERIES[name](spark, f"{edge_dir}/empty").collect() == []
