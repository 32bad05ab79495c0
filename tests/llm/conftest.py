import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]
from llmdata import LONG, SF_DIR  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with the names that operators use themselves."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en"),
        (1, "alpha beta gamma delta epsilon zeta", "en"),
        (1, "another text under the same id", "en"),
        (2, None, None),
        (3, "", "en"),
        (None, "alpha beta gamma delta epsilon zeta", "en"),
        (None, None, None),
        (4, LONG, "en"),
        (5, "¡Ünïcode, ñandú! 中文  x y 'tis <|endoftext|>", "es"),
        (6, " \t\n ", "es"),
        (7, "42", None),
    ]
    names = ["doc", "code", "score", "text_key", "id_key", "key", "n", "words"]
    wide = [(*r, r[2], *["clash"] * len(names)) for r in rows]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(wide, schema)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def edge_dir(spark, edge, tmp_path_factory):
    """A folder of tables with edge cases, and one of empty tables."""
    top = tmp_path_factory.mktemp("edge")
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (5, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int"
    )
    benchmark = spark.createDataFrame(
        [(1, "beta gamma delta"), (1, "beta gamma delta"), (2, None), (3, ""), (None, "same id"), (4, LONG)],
        "item_id long, text string",
    )
    for name, full in (("full", True), ("empty", False)):
        for table, frame in (("documents", edge), ("labels", labels), ("benchmark", benchmark)):
            (frame if full else frame.where("false")).write.parquet(f"{top}/{name}/{table}.parquet")
    return top
