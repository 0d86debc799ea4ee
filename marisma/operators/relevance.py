"""Whether an article is about animal health, and which of its claims is looked at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions import facts, text

#: Letters of a word where topics are looked for.
LETTERS = "a-z0-9áéíóúüñ"
THRESHOLD = 0.15
# Words of the topic, weaker ones, and what marks a source of animal health.
TOPIC = (
    "gusano barrenador", "gripe aviar", "peste porcina", "influenza aviar", "h5n1", "h5n2", "h5n6", "h7n9", "cochliomyia", "screwworm", "senasica", "woah", "wahis", "oie", "zoonosis", "outbreak", "brote", "myiasis", "hog cholera",
    "avian influenza", "classical swine fever", "hpai", "lpai", "animal health", "salud animal", "poultry", "livestock", "veterinary", "aves de corral", "bioseguridad", "epizoot", "new world screwworm", "bird flu", "swine fever",
    "foot and mouth", "aftosa", "rabia", "brucelosis", "tuberculosis bovina",
)
WEAK = (
    "animal", "livestock", "poultry", "veterinary", "zoonos", "outbreak", "brote", "ganado", "aves", "farm", "influenza", "disease", "salud animal", "woah", "oie", "senasica", "fao", "wahis", "epizoot", "herd", "flock", "swine", "avian", "cattle", "pig", "bird flu", "vaccine", "vacuna",
    "cuarentena", "sanidad", "zoosanit", "h5n", "hpai", "screwworm", "barrenador", "porcino", "bovino", "ovino", "caprino", "equino", "pollo", "gallina", "pavo", "cerdo", "bioseguridad", "depopul", "sacrificio", "miasis", "myiasis", "pest", "peste", "corral",
    "aphis", "usda", "cidrap", "wahid",
)
KEEP_KINDS = ("official", "official_international", "veterinary_media", "veterinary", "research", "epidemiological", "genomic", "surveillance")
KEEP_CATEGORIES = ("official", "veterinary", "surveillance", "research", "epidemiological")
KEEP_DOMAINS = ("woah.org", "fao.org", "aphis.", "senasica", "cidrap", "poultry", "pigsite")


def count(x: Column, terms: Sequence[str]) -> Column:
    """How many of the terms stand in x: words as words, those with a space or a dot anywhere; in one pass for each kind."""
    out = F.lit(0)
    for own, letters in ((True, LETTERS), (False, None)):
        some = [t for t in terms if facts.strict(t) == own]
        if some:
            place = {t: i for i, t in enumerate(some)}
            out = out + F.size(text.numbers_of(text.found_terms(x, some, letters), {t: [place[s] for s in ts] for t, ts in text.implied(some, letters).items()}))
    return out


#: An article of a source with assigned diseases that is shorter than this is not thrown away for what it doesn't say.
SHORT = 80


def watched(kind: Column, category: Column, domain: Column, assigned: Column) -> Column:
    """Whether a source is one of animal health: by its kind, its category, the diseases assigned to it (an array) or its domain."""
    kind = F.replace(F.lower(F.coalesce(kind, F.lit(""))), F.lit(" "), F.lit("_"))
    return kind.isin(*KEEP_KINDS) | F.lower(F.coalesce(category, F.lit(""))).isin(*KEEP_CATEGORIES) | (F.coalesce(F.size(assigned), F.lit(0)) > 0) | facts.any_of(F.lower(F.coalesce(domain, F.lit(""))), KEEP_DOMAINS)


def judged(rows: DataFrame, body: Column, title: Column, kind: Column, domain: Column, category: Column | None = None, assigned: Column | None = None) -> DataFrame:
    """Adds score (0 to 1), skip, kept (for its source's sake or its own) and bucket (discard, low, analyze, high).

    A headline of 20 characters or more that says nothing of the topic is enough to skip, but for sources of animal health; these also keep
    articles with a weak word, and short ones where the source has assigned diseases.
    """
    body, title = (F.coalesce(x, F.lit("")) for x in (body, title))
    category = F.lit("") if category is None else category
    assigned = F.array().cast("array<string>") if assigned is None else assigned
    part = lambda n: F.least(F.lit(1.0), n / F.lit(3.0))
    weak = facts.any_word(F.lower(body), WEAK, LETTERS)
    named = (F.size(assigned) > 0) & (F.length(text.bare(body)) < SHORT)
    out = text.once(rows, score=part(count(body, TOPIC)), title_score=part(count(title, TOPIC)), watched=watched(kind, category, domain, assigned), weak=weak, named=F.coalesce(named, F.lit(False)))
    off_topic = (F.length(text.bare(title)) >= 20) & ~F.col("watched") & (F.col("title_score") < THRESHOLD)
    skip = F.when(off_topic, True).when(F.col("score") >= THRESHOLD, False).when(F.col("watched") & ((F.col("score") > 0) | F.col("weak") | F.col("named")), False).otherwise(True)
    out = out.withColumn("skip", skip)
    bucket = F.when(F.col("skip"), "discard").when(F.col("score") < 0.5, "low").when(F.col("score") < 0.8, "analyze").otherwise("high")
    return out.withColumns({"kept": F.col("watched") & ~F.col("skip"), "bucket": bucket}).drop("title_score", "watched", "weak", "named")


def review_claim(rows: DataFrame, claim: Column, title: Column, verifiable: Column, label: Column) -> DataFrame:
    """Adds score and claim: what a reviewer is shown of a claim, or the title where the claim is short or shares hardly a word with it."""
    clean = text.collapse(F.regexp_replace(F.coalesce(claim, F.lit("")), r"(?is)[ ]*20[0-9]{6}T[0-9]{6,9}Z.*$", ""))
    rows = text.once(rows.withColumn("own_title", title), clean=clean)
    rows = text.once(rows, own=text.tokens(F.col("clean"), facts.STOP), of_title=text.tokens(F.coalesce("own_title", F.lit("")), facts.STOP), yes=verifiable, told=label)
    shared = F.size(F.array_intersect("own", "of_title"))
    anchored = F.arrays_overlap("own", F.array(*[F.lit(a) for a in facts.ANCHORS]))
    score = F.when(F.col("yes"), 2).otherwise(0) + F.when(F.col("told").isin("Supported", "Contradicted"), 3).otherwise(0) + F.least(F.lit(4), shared) + F.when(anchored, 2).otherwise(0) - F.when(F.size("own") > 80, 2).otherwise(0)
    rows = text.once(rows, score=F.when(F.length("clean") < 24, -99).otherwise(score), shared=shared)
    shown = F.when(F.col("score") < 0, F.col("own_title")).when((F.col("shared") < 2) & (F.size("of_title") >= 4), F.col("own_title")).otherwise(F.col("clean"))
    return rows.withColumn("claim", shown)
