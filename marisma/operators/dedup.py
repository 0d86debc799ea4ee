"""First-seen deduplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.operators import graph
from marisma.session import shared_checkpoints, ship


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the first by order stays, of equal ones the first by all columns; null keys all stay. One aggregate, combined before the exchange."""
    rest = [c for c in rows.columns if c != order]
    first = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("first_key")).agg(F.min(F.struct(order, *rest)).alias("r"))
    return first.select("r.*").select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))


#: Rows of a component that one task may decide; rows of one such task, about.
COMPONENT, SLOT = 200_000, 20_000


def cascade(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows in order, each kept unless one of its keys is that of an earlier kept row; a rejected row takes no key. A null key is none; order is distinct.

    One round decides most rows: a row stays that is the first of each of its keys, and rows that share a key with it go. What is left is cut into
    connected components, in a number of rounds that grows with the logarithm of the longest chain, and each component is decided
    in order by one task. Components of more than COMPONENT rows go through further rounds first, which shrink them. Every round writes only what it decides
    and what is left, to the shared folder.
    """
    shared_checkpoints(rows.sparkSession)
    ship(rows.sparkSession)
    names = [f"_k{i}" for i in range(len(keys))]
    left = rows.select(F.col(order).alias("_o"), *[F.when(F.col(k).isNotNull(), F.xxhash64(F.col(k).cast("string"), F.lit(i))).alias(n) for i, (k, n) in enumerate(zip(keys, names, strict=True))], *[F.col(k).cast("string").alias(f"{n}_text") for k, n in zip(keys, names, strict=True)])
    left, kept = left.checkpoint(), []
    while not left.isEmpty():
        sure, left = _round(left, names)
        kept.append(sure)
        links = None
        for n in names:
            first = left.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("_o").alias("_first"))
            some = left.join(first, n).where("_first <> _o").select(F.col("_o").alias("a"), F.col("_first").alias("b"))
            links = some if links is None else links.union(some)
        root = graph.components(links, "a", "b")
        placed = left.join(root, F.col("_o") == F.col("node"), "left").withColumn("root", F.coalesce("root", "_o")).drop("node")
        large = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMPONENT).select("root").checkpoint()
        small = placed.join(F.broadcast(large), "root", "left_anti")
        slots = max(1, small.count() // SLOT)
        kept.append(small.withColumn("_slot", F.pmod(F.xxhash64("root"), F.lit(slots))).groupBy("_slot").applyInPandas(_in_order(names), f"_o {left.schema['_o'].dataType.simpleString()}"))
        left = placed.join(F.broadcast(large), "root", "left_semi").select(*left.columns).checkpoint()
    if not kept:
        return rows
    stay = kept[0]
    for some in kept[1:]:
        stay = stay.union(some)
    return rows.join(stay, rows[order] == stay["_o"], "left_semi")


def _round(left: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that are the first of each of their keys, and those that share no key with one of them."""
    sure = left
    for n in names:
        own = f"{n}_text"
        first = left.where(F.col(own).isNotNull()).groupBy(F.col(own).alias("_k")).agg(F.min("_o").alias("_first"))
        sure = sure.join(first, F.col(own) == F.col("_k"), "left").where(F.col("_first").isNull() | (F.col("_first") == F.col("_o"))).drop("_k", "_first")
    sure = sure.checkpoint()
    rest = left.join(sure.select("_o"), "_o", "left_anti")
    for n in names:
        rest = rest.join(sure.where(F.col(f"{n}_text").isNotNull()).select(F.col(f"{n}_text").alias("_k")), F.col(f"{n}_text") == F.col("_k"), "left_anti")
    return sure.select("_o"), rest.checkpoint()


def _in_order(names: list[str]):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_o")
        taken: list[set] = [set() for _ in names]
        stay = []
        for o, *own in part[["_o", *[f"{n}_text" for n in names]]].itertuples(index=False):
            if not any(k is not None and k in t for k, t in zip(own, taken, strict=True)):
                stay.append(o)
                for k, t in zip(own, taken, strict=True):
                    if k is not None:
                        t.add(k)
        return pd.DataFrame({"_o": stay})

    return run
