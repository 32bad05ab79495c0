"""Connected components by alternating stars, every round written to the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.llm.common import written


def _star(edges, large):
    """One round: neighbours of every node point at the smallest one (edges run from larger to smaller)."""
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        seen = seen.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    lowest = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = seen.join(lowest, "u")
    if large:
        moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.where(F.col("a") != F.col("b")).distinct()


def _state(edges):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root: the smallest node of its component.

    ``edges``: columns a and b of one orderable type. Each round halves paths at
    least, so their number grows with the logarithm of the longest chain. Minima
    combine on the map side; a node with very many edges is a row of the smaller
    join side, and AQE splits the other. Only a count and a checksum of a round
    reach the driver, to see when nothing changes any more.
    """
    current = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = _state(current)
    while before[0]:
        current = written(_star(_star(current, True), False), "links")
        after = _state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b"), F.col("b")).distinct()
    )
