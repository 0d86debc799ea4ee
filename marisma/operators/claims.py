"""Claims of articles: extraction, checks, diagnostics, contrast with a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions import hashing, text


def claims(docs: DataFrame, key: str, column: str = "text", shortest: int = 20, most: int = 8) -> DataFrame:
    """Distinct sentences of `shortest` characters or more that end with . ! or ?, the first `most` of each row: key, pos, claim, claim_id."""
    found = text.ended(F.col(column))
    kept = F.slice(F.array_distinct(F.filter(found, lambda s: F.length(s) >= shortest)), 1, most)
    rows = docs.select(key, F.posexplode(kept).alias("pos", "claim"))
    return rows.withColumn("claim_id", F.substring(hashing.sha(F.substring("claim", 1, 200)), 1, 32))


def verifiable(claim: Column) -> Column:
    """A claim can be checked if it is no question and has a number or is long."""
    return ~claim.endswith("?") & (claim.rlike("[0-9]") | (F.length(claim) >= 60))


def diagnostics(claim: Column, snippet: Column, anchors: Sequence[str], stop: Sequence[str] = ()) -> Column:
    """What claim and snippet share: struct(tokens, shared, anchors, specific)."""
    own = text.tokens(claim, stop)
    both = F.array_intersect(own, text.tokens(snippet, stop))
    held = F.array_intersect(both, F.array(*[F.lit(a) for a in anchors]))
    return F.struct(F.size(own).cast("long").alias("tokens"), F.size(both).cast("long").alias("shared"), F.size(held).cast("long").alias("anchors"), (F.size(both) - F.size(held)).cast("long").alias("specific"))


def stance(found: Column, official: Column, misinformation: Column) -> Column:
    """Unknown unless an official snippet shares enough, or speaks against a claim of misinformation."""
    enough = official & (found["tokens"] >= 5) & (found["shared"] >= 6) & (found["anchors"] >= 2) & (found["specific"] >= 2)
    return F.when(misinformation & official, "Contradicted").when(enough, "Supported").otherwise("Unknown")


def matched(claims: DataFrame, corpus: DataFrame, key: str, tag: str, title: str, official: str, most_official: int = 4, most_peers: int = 8) -> DataFrame:
    """Corpus rows with a claim's tag, one for each title, at most so many official and other ones: equality on the tag, then a capped turn."""
    from marisma.operators.facets import top_per_group

    # every claim of a tag gets the same titles: they are cut before the join
    few = top_per_group(corpus.select(tag, title, official).distinct(), [tag, official], [F.col(title)], max(most_official, most_peers))
    few = few.where(F.col("turn") <= F.when(F.col(official), most_official).otherwise(most_peers))
    return claims.select(key, tag).join(few, tag).select(key, official, title, "turn")
