"""Connected components by alternating stars, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import discard, join_hot, materialize

MAX_ROUNDS = 60


def _minima(edges: DataFrame) -> DataFrame:
    return materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "minima")


def _large_star(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Every node ties its larger neighbours to its least neighbour (or itself). edges: a > b."""
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = _minima(edges.unionByName(up))
    joined = join_hot(up, least.select("a", F.least("a", "m").alias("m"), "n"), "a", rows_total=total)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), least


def _small_star(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Every node ties itself and its smaller neighbours to the least of them."""
    least = _minima(edges)
    others = join_hot(edges, least, "a", rows_total=total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), least


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the undirected ``edges`` (a, b) the least node that it can reach.

    Nodes are any ordered type. Loops, repeats and edges with a null end are
    ignored, and a node without another edge isn't returned. Edges shrink to
    one star a component in a number of rounds that grows as a logarithm of
    the longest path; each round is written to the shared folder, the round
    before deleted, and the driver sees a count and a checksum alone. A centre
    with very many edges is pre-aggregated (its least neighbour) and met by
    ``join_hot``, so that its edges aren't sent to one task.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(edges, "edges"), None
    total = edges.count()
    for _ in range(MAX_ROUNDS):
        large, used = _large_star(edges, total)
        starred = materialize(large, "edges")
        discard(edges, used)
        small, used = _small_star(starred, starred.count())
        edges = materialize(small, "edges")
        discard(starred, used)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, total = now, now[0]
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
