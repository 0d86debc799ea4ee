"""Weighted graphs of what occurs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.session import shared_checkpoints


def edges(links: DataFrame, a: str, b: str, label: str, seq: str) -> DataFrame:
    """Undirected edges without loops: how often, and the label that came first."""
    rows = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(label).alias("label"), F.col(seq).alias("seq"))
    out = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("value"), F.min(F.struct("seq", "label")).alias("first"))
    return out.select("a", "b", "value", F.col("first.label").alias("label"))


def node_weights(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("node"), "value").unionByName(edges.select(F.col("b").alias("node"), "value"))
    return ends.groupBy("node").agg(F.sum("value").cast("bigint").alias("weight"), F.count(F.lit(1)).alias("degree"))


def prune(edges: DataFrame, k: int) -> DataFrame:
    """Edges between the k heaviest nodes."""
    top = F.broadcast(node_weights(edges).orderBy(F.desc("weight"), "node").limit(k).select("node"))
    return edges.join(top.select(F.col("node").alias("a")), "a", "left_semi").join(top.select(F.col("node").alias("b")), "b", "left_semi")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node that links (a, b) reach from each of their nodes.

    Every node is hung on the smallest neighbour of its neighbours and then of its own, in turn; the number of rounds grows with the logarithm of the longest
    path. Rounds are cut by checkpoints in the shared folder.
    """
    shared_checkpoints(links.sparkSession)
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        edges = hung.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
