"""Tables after a write, as a DataFrame to be written over the old one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.operators import dedup


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Old rows, and of the new ones the first by order (then by all columns) with each key that the old ones lack.

    A row with a null in its key has none: all of these are inserted.
    """
    rest = [c for c in new.columns if c != order]
    first = new.dropna(subset=list(keys)).groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(order, *rest)).alias("r"))
    fresh = first.select("r.*").select(*new.columns).join(old.select(*keys), [*keys], "left_anti")
    bare = new.where(" or ".join(f"`{k}` is null" for k in keys))
    return old.unionByName(fresh.select(*old.columns)).unionByName(bare.select(*old.columns))


def insert_unique(old: DataFrame, new: DataFrame, unique: Sequence[Sequence[str]], order: str) -> DataFrame:
    """Old rows, and of the new ones in order (which is distinct) each that no old or inserted row equals in any of several keys."""
    names, fresh = [], new
    for i, keys in enumerate(unique):
        fresh = fresh.join(old.select(*keys).dropna(), [*keys], "left_anti")
        names.append(f"unique_{i}")
    whole = lambda keys: F.when(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull(), F.to_json(F.struct(*keys)))
    fresh = fresh.select(*new.columns, *[whole(keys).alias(n) for n, keys in zip(names, unique, strict=True)])
    return old.unionByName(dedup.cascade(fresh, names, order).select(*old.columns))


def replace_members(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Membership after a write: every owner that comes with new members loses all its old ones; equal rows are one."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").select(*old.columns).unionByName(new.select(*old.columns)).distinct()


def put_translations(cache: DataFrame, new: DataFrame, most: int = 8000) -> DataFrame:
    """A cache keyed by the hash of the whole source text, which itself is kept to `most` characters; the last row of a text replaces the others."""
    from marisma.functions import hashing

    rows = new.select(hashing.sha(F.col("source_text")).alias("text_hash"), F.substring("source_text", 1, most).alias("source_text"), "translated", "provider", "created_at")
    return replace_last(cache.unionByName(rows), ["text_hash"], "created_at")


def replace_entities(old: DataFrame, new: DataFrame, owner: str, kinds: Sequence[str]) -> DataFrame:
    """Entities (owner, kind, value) after a write: those of some kinds are replaced for the owners that come, others stay; values that differ by case alone are one, the old one first."""
    stay = old.join(new.select(owner).distinct(), owner, "left_anti").select(*old.columns).unionByName(old.where(~F.col("kind").isin(*kinds)).join(new.select(owner).distinct(), owner, "left_semi").select(*old.columns))
    both = stay.withColumn("turn", F.lit(0)).unionByName(new.select(*old.columns).withColumn("turn", F.lit(1)))
    first = both.groupBy(owner, "kind", F.lower(F.trim("value")).alias("low")).agg(F.min(F.struct("turn", "value")).alias("v"))
    return first.select(owner, "kind", F.col("v.value").alias("value"))


def kept_copies(copies: DataFrame, at: str, keep: int = 7) -> DataFrame:
    """Adds removed: copies older than the newest `keep` (by time, then all columns) go."""
    newest = copies.orderBy(F.desc(at), *copies.columns).limit(max(0, keep))
    return copies.join(newest.select(*copies.columns, F.lit(False).alias("removed")), copies.columns, "left").withColumn("removed", F.coalesce("removed", F.lit(True)))


def replace_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of the rows with one key the last by order: an aggregate, combined before the exchange."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, *[F.col("last")[c].alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """New rows are added; where a key exists only the columns to update take new values that are not null, all others stay."""
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns], F.lit(True).alias("_new"))
    on = [F.col(k) == F.col(f"_n_{k}") for k in keys]
    both = old.withColumn("_old", F.lit(True)).join(n, on, "full_outer")
    cells = []
    for c in old.columns:
        if c not in new.columns:
            cells.append(F.col(c))
        elif c in update:
            cells.append(F.coalesce(f"_n_{c}", c).alias(c))
        else:
            cells.append(F.when(F.col("_old").isNull(), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*cells)


def patched(old: DataFrame, new: DataFrame, keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Old rows with the values that new has for them in the allowed columns; values of other columns, null ones, and rows that are not there are left out. A column that old lacks can't be allowed."""
    unknown = [c for c in allowed if c not in old.columns]
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    some = [c for c in new.columns if c in allowed and c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in some])
    return old.join(n, list(keys), "left").select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in some else F.col(c) for c in old.columns])


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the doomed keys."""
    return parents.join(doomed, key, "left_anti"), children.join(doomed, key, "left_anti")


def append_jsonl(rows: DataFrame, path: str, by: str) -> None:
    """Raw log: JSON lines, one folder for each value of `by`."""
    rows.write.mode("append").partitionBy(by).json(path)
