"""Matching texts against editable lexicons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions import text

#: term, category, weight
Lexicon = Sequence[tuple[str, str, int]]


def hits(x: Column, lexicon: Lexicon) -> Column:
    """Terms of the lexicon that stand in x as whole words: array of struct(term, category, weight), in the lexicon's order.

    Terms are literal, of one word or several. All are looked for in one pass over x; what it costs hardly depends on their number.
    The lexicon is a literal of the plan: its size is that of an editable list, and no join is needed.
    """
    of: dict[str, list[int]] = {}
    for i, (term, _, _) in enumerate(lexicon):
        of.setdefault(term.lower(), []).append(i)
    table = {t: [i for s in ts for i in of[s]] for t, ts in text.implied(list(of)).items()}
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(c).alias("category"), F.lit(w).alias("weight")) for t, c, w in lexicon])
    return F.transform(text.numbers_of(text.found_terms(x, list(of)), table), lambda i: F.element_at(rows, i + 1))


def relevance(n: Column, enough: int = 3) -> Column:
    return F.least(F.lit(1.0), n / F.lit(float(enough)))


def relevance_bucket(score: Column) -> Column:
    return F.when(score < 0.15, "discard").when(score < 0.5, "low").when(score < 0.8, "analyze").otherwise("high")


def sentence_hits(docs: DataFrame, key: str, lexicon: Lexicon, column: str = "text") -> DataFrame:
    """One row for each sentence with hits: key, pos, sentence, hits."""
    rows = docs.select(key, F.posexplode_outer(text.sentences(F.col(column))).alias("pos", "sentence"))
    return text.once(rows, hits=hits(F.col("sentence"), lexicon)).where(F.size("hits") > 0)


def category_pairs(found: DataFrame, key: str) -> DataFrame:
    """Unordered pairs of categories of a sentence: how many sentences hold both, in how many documents, the force of the pair."""
    from marisma.functions.scoring import pair_force

    rows = text.once(found.select(key, "hits"), c=F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["category"])))).where(F.size("c") > 1)
    rows = rows.select(key, "c", F.explode("c").alias("a")).select(key, "a", F.explode("c").alias("b")).where("a < b")
    # counted within documents first: one row of each document and pair goes on
    rows = rows.groupBy("a", "b", key).agg(F.count(F.lit(1)).alias("n"))
    out = rows.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    return out.withColumn("force", pair_force(F.col("n"), F.lit(True)))


def term_cloud(found: DataFrame, k: int) -> DataFrame:
    """The k most frequent terms; of equal ones the first in alphabet."""
    return found.select(F.explode("hits.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(k)


def first_inserted(found: DataFrame, key: str, label: str = "term") -> DataFrame:
    """label, n, first: how often each term or category of the hits stands, and where it does first (document, sentence, place among its hits), both in one aggregate that is combined before the exchange."""
    cells = found.select(key, "pos", F.posexplode(f"hits.{label}").alias("i", label))
    return cells.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "pos", "i")).alias("first"))


def most_common(counts: DataFrame, k: int | None = None) -> DataFrame:
    """Rows of first_inserted() by count, of equal ones the one that came first."""
    out = counts.orderBy(F.desc("n"), "first")
    return out if k is None else out.limit(k)


def structures(found: DataFrame, key: str, specs: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """label, n, first: sentences that have all categories of a structure and, where it names any, one of its words (categories, words)."""
    low = text.fold_accents(F.col("sentence"))
    own = F.transform("hits", lambda h: h["category"])
    tests = []
    for label, (need, words) in specs.items():
        fits = F.size(F.array_except(F.array(*[F.lit(c) for c in need]), own)) == 0
        if words:
            fits = fits & low.rlike("|".join(text.quoted(w) for w in words))
        tests.append(F.when(fits, label))
    cells = found.select(key, "pos", F.posexplode(F.array_compact(F.array(*tests))).alias("i", "label"))
    return cells.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "pos", "i")).alias("first"))


def overlay(defaults: DataFrame, edited: DataFrame) -> DataFrame:
    """Active edited terms with their weight held in 1 to 5; the defaults where a category has no active one."""
    active = edited.where("active = 1").select("term", "category", F.least(F.greatest("weight", F.lit(1)), F.lit(5)).alias("weight"))
    return active.unionByName(defaults.join(active.select("category").distinct(), "category", "left_anti").select("term", "category", "weight"))
