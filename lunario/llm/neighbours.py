"""Approximate nearest neighbours by cosine over sharded proximity graphs.

Equal vectors are one node that carries its smallest ids, as many as a result
can hold; a vector that a third of all rows share is thus one node. Nodes are
dealt to shards of about ``SHARD_NODES`` by a hash; every shard builds its own
robust-pruned directed graph (``proximity_graph``), written as rows of a table,
so an index is all rows and any search can use it. Queries, distinct vectors in
blocks, visit every shard by beam search; all that a beam holds is scored again in
double precision on the original vectors, and the best of all shards stay.

Defined results: null vectors, vectors with null or non-finite components, zero
vectors and rows without id take no part. Vectors are compared with those of
their own length. Rows with one id count as one if their vectors are equal; a
query never returns its own id. Fewer candidates than asked for give fewer rows,
empty tables none. Other columns are not looked at.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lunario.llm.common import written
from lunario.llm.proximity_graph import beam_search, built, entry_points

NEIGHBOURS = 5
SHARD_NODES = 4096
QUERY_BLOCK = 4096
BEAM = 64
EVERY = 50


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    doubles = F.col("embedding").cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = vectors.select(F.col("vec_id").cast("long"), doubles.alias("embedding"))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return taken.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & nonzero)


def distinct_vectors(vectors: DataFrame, ids: int) -> DataFrame:
    """(embedding, ids): every distinct vector with its ``ids`` smallest ids."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= ids)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(column):
    return np.array(column.tolist(), np.float64)


def _unit(matrix):
    return (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).astype(np.float32)


def _shard_graph(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("node", kind="stable").reset_index(drop=True)
    edges = built(_unit(_matrix(group["embedding"])))
    return group.assign(place=np.arange(len(group)), edges=[e[e >= 0].tolist() for e in edges])


INDEX = "size int, shard int, node long, ids array<long>, embedding array<double>, place int, edges array<int>"


def graph_index(nodes: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Graph rows of ``nodes`` (embedding, ids), one a node, written."""
    shards = max(1, math.ceil(nodes.count() / shard_nodes))
    node = F.col("ids")[0]
    dealt = nodes.select(
        F.size("embedding").alias("size"),
        F.pmod(F.xxhash64(node), F.lit(shards)).cast("int").alias("shard"),
        node.alias("node"),
        "ids",
        "embedding",
    )
    return written(dealt.groupBy("size", "shard").applyInPandas(_shard_graph, INDEX), "graph")


def _found(rows):
    query, ids, score = zip(*rows) if rows else ((), (), ())
    # ids as objects: an empty column has no type of its own
    columns = {"query": pd.Series(query, dtype="int64"), "ids": pd.Series(ids, dtype=object)}
    return pd.DataFrame(columns | {"score": pd.Series(score, dtype="float64")})


def _searched(found_per_shard, beam):
    def search(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if graph.empty or asked.empty:
            return _found([])
        graph = graph.sort_values("place")
        original, points = _matrix(graph["embedding"]), _matrix(asked["embedding"])
        vectors = _unit(original)
        edges = np.full((len(graph), max(1, graph["edges"].map(len).max())), -1, np.int64)
        for row, ends in enumerate(graph["edges"]):
            edges[row, : len(ends)] = ends
        length, entry, ids = np.linalg.norm(original, axis=1), entry_points(vectors), graph["ids"].to_numpy()
        nodes, out = graph["node"].to_numpy(), []
        for low in range(0, len(points), 256):
            part = points[low : low + 256]
            near, _ = beam_search(vectors, edges, entry, _unit(part), beam)
            for query, point, found in zip(asked["query"].iloc[low : low + 256], part, near):
                found = found[found >= 0]
                score = original[found] @ point / (length[found] * np.linalg.norm(point))
                best = np.lexsort((nodes[found], -score))[:found_per_shard]
                out += [(query, ids[k].tolist(), s) for k, s in zip(found[best], score[best].tolist())]
        return _found(out)

    return search


def search(index: DataFrame, queries: DataFrame, found: int, beam: int = BEAM) -> DataFrame:
    """(query, ids, score): the ``found`` nearest nodes of every query (query, embedding) over all shards."""
    # named anew: the index itself is the other side below
    shards = index.select(F.col("size").alias("size"), F.col("shard").alias("shard")).distinct()
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    asked = queries.select(
        "query",
        "embedding",
        F.size("embedding").alias("size"),
        F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"),
    ).join(shards, "size")
    every = F.array(*[F.lit(b) for b in range(blocks)])
    held = index.withColumn("block", F.explode(every))
    keys = ["size", "shard", "block"]
    met = (
        held.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(_searched(found, beam), "query long, ids array<long>, score double")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= found).drop("place")


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row of ``vectors`` that ``is_query`` names."""
    taken = usable(vectors)
    nodes = written(distinct_vectors(taken, k + 1), "nodes")
    asking = taken.where(is_query).distinct().join(nodes.select("embedding", F.col("ids")[0].alias("query")), "embedding")
    asking = written(asking.select("vec_id", "query", "embedding"), "queries")
    found = search(graph_index(nodes), asking.select("query", "embedding").distinct(), k + 1)
    pairs = asking.select(F.col("vec_id").alias("query_id"), "query").join(found, "query")
    pairs = pairs.select("query_id", F.explode("ids").alias("vec_id"), "score").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_proximity_graph_search(spark, sf_dir):
    """Contract query: the rows of ``embeddings`` whose vec_id is divisible by 50 against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % EVERY == 0)
