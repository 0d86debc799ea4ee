"""Small rules of names, dates and scores, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marisma.functions import dates, facts, text, urls

# Which disease a path of an official page is about, in the order they are tried.
URL_DISEASES = {
    "avian-influenza": "gripe_aviar", "bird-flu": "gripe_aviar", "screwworm": "gusano_barrenador", "classical-swine-fever": "fiebre_porcina_clasica", "peste-porcina-clasica": "fiebre_porcina_clasica", "foot-and-mouth": "fiebre_aftosa",
}
# What an address says of a picture, and how surely.
OFFICIAL_PICTURES = ("gob.mx", "woah.org", "who.int", "fao.org", "cdc.gov", "usda.gov", "paho.org")
SOCIAL_PICTURES = ("twitter.com", "x.com", "facebook.com", "instagram.com", "tiktok.com")
BIOGRAPHY = ("joined the united nations", "secretary-general", "serving as un system", "coordinator of the m", "special representative for food")


def url_diseases(url: Column) -> Column:
    """Ids of the diseases that an address names, sorted."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(n)), d) for n, d in URL_DISEASES.items()]))))


def day_of_news(published: Column, collected: Column) -> Column:
    """Day as text by any layout (compact, ISO in UTC, mail), of publication, else of collection."""
    return F.date_format(dates.day(published, collected), "yyyy-MM-dd")


def day_plain(x: Column) -> Column:
    """Day as text of ISO or mail dates alone; a compact date is none, and no offset is taken off."""
    t = F.trim(x)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10))
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|UT|[+-]\d{4})$", "")
    return F.coalesce(F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"), F.date_format(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")), "yyyy-MM-dd"), F.lit(""))


def day_raw(x: Column) -> Column:
    """The first ten characters, whatever they are."""
    return F.substring(F.coalesce(x, F.lit("")), 1, 10)


def first_iso(*x: Column) -> Column:
    """The first of several texts that is an ISO date or time."""
    return F.coalesce(*[F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.trim(c))) for c in x])


def minutes_until(then: Column, now: Column) -> Column:
    """Whole minutes from now to then, not below 0; null without a date."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.floor((F.unix_timestamp(then.cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))) / 60)))


def share_of_four(x: Column, terms: Sequence[str]) -> Column:
    """A quarter for each of the terms that x holds anywhere, at most 1."""
    low, n = F.lower(F.coalesce(x, F.lit(""))), F.lit(0)
    for t in terms:
        n = n + F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0)
    return F.round(F.least(F.lit(1.0), n / F.lit(4.0)), 3)


def picture_class(url: Column) -> Column:
    """struct(label, confidence) of what an address says of a picture; null if nothing."""
    host, low = urls.host(url), F.lower(F.coalesce(url, F.lit("")))
    some = lambda c, words: facts.any_of(c, words)
    of = lambda label, sure: F.struct(F.lit(label).alias("label"), F.lit(sure).alias("confidence"))
    return (
        F.when(host == "", F.lit(None)).when(some(host, OFFICIAL_PICTURES), of("OFFICIAL_DOCUMENT", 0.78)).when(some(host, SOCIAL_PICTURES), of("SOCIAL_MEDIA", 0.76))
        .when(some(host, ("youtube.com", "youtu.be", "ytimg.com")), of("PHOTOGRAPH", 0.7)).when(some(low, ("meme", "funny")), of("MEME", 0.65))
    )


def filled_scores(label: Column, confidence: Column, classes: Sequence[str]) -> Column:
    """A score for every class: the confidence for the label, and the rest in equal parts (0.02 at least) for the others."""
    rest = F.round(F.greatest(F.lit(0.02), (1 - confidence) / max(1, len(classes) - 1)), 4)
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), F.array(*[F.when(label == c, F.round(confidence, 4)).otherwise(rest) for c in classes]))


def source_name(url: Column, hosts: Mapping[str, str], name: Column, kind: Column) -> Column:
    """How a source is shown: by its host, a domain above it, its name or type unless that is a code, its host, else a word."""
    host = F.when(url.rlike("^https?://"), F.lower(F.regexp_extract(url, "^https?://([^/?#:]*)", 1))).otherwise("")
    plain = lambda c: F.when((F.coalesce(F.trim(c), F.lit("")) != "") & ~F.upper(c).startswith("SRC-"), c)
    out = F.coalesce(plain(name), plain(F.trim(kind)), F.when(host != "", F.replace(host, F.lit("www."), F.lit(""))), F.lit("Fuente"))
    for domain, label in reversed(list(hosts.items())):
        out = F.when((host == domain) | host.endswith("." + domain), label).otherwise(out)
    return out


def is_biography(x: Column) -> Column:
    return facts.any_of(F.lower(F.coalesce(x, F.lit(""))), BIOGRAPHY)


def merged(stored: Column, computed: Column) -> Column:
    """Two maps as one: what is stored wins, what it lacks is computed."""
    return F.map_concat(F.map_filter(computed, lambda k, _: ~F.map_contains_key(stored, k)), stored)


def shown_text(x: Column, cached: Column, source_like: bool, most: int = 2500) -> Column:
    """A text as it is shown in translation: blank ones and those of the target language as they are, else the cached one, else its first characters."""
    same = F.lit(source_like) | (F.coalesce(F.trim(x), F.lit("")) == "")
    return F.when(same, x).otherwise(F.coalesce(text.non_empty(cached), F.substring(x, 1, most)))
