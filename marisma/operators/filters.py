"""Filtered, ordered and paged listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What else a verdict may be called.
VERDICT_ALIASES = {"respaldado": ("respald", "supported"), "insuficiente": ("insufic",), "contradicho": ("contrad",), "engañoso": ("engañ", "engan", "mislead"), "revision_humana": ("humana", "revision", "review"), "sin_verificar": ("unknown", "sin verificar", "sin_verificar")}


# Hosts and words that tell where an article comes from, and other names of an origin.
ORIGINS = ("youtube", "cientifico", "oficial", "social", "prensa")
ORIGIN_ALIASES = {"redes": "social", "red": "social"}
SCIENCE, OFFICIAL = ("openalex.org", "pubmed", "doi.org"), ("woah.org", "oie.int", "senasica", "gob.mx", "fao.org", "who.int", "cdc.gov", "usda.gov")
SOCIAL, SOCIAL_KINDS = ("twitter.com", "x.com", "facebook.com", "linkedin.com", "reddit.com"), ("social", "twitter", "linkedin", "facebook")


def origin_id(value: str | None) -> str | None:
    """The origin that a request means; None, which filters nothing, for a name that is none."""
    key = (value or "").strip().lower().replace(" ", "_")
    key = ORIGIN_ALIASES.get(key, key)
    return key if key in ORIGINS else None


def origin(url: Column, kind: Column, title: Column) -> Column:
    """Where an article comes from; the first test that holds decides."""
    u, k, t = (F.lower(F.coalesce(c, F.lit(""))) for c in (url, kind, title))

    def has(c: Column, *parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(c, F.lit(p))
        return out

    return (
        F.when(has(u, "youtube", "youtu.be") | has(k, "youtube"), "youtube")
        .when(has(u, *SCIENCE) | has(t, "pubmed", "openalex") | has(k, "cientif", "investig"), "cientifico")
        .when(has(u, *OFFICIAL) | has(t, "senasica", "official portal") | has(k, "oficial"), "oficial")
        .when(has(u, *SOCIAL) | has(k, *SOCIAL_KINDS), "social")
        .otherwise("prensa")
    )


def verdict_key(value: Column) -> Column:
    b = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return (
        F.when(F.contains(b, F.lit("respald")) | (b == "supported"), "respaldado").when(F.contains(b, F.lit("insufic")), "insuficiente").when(F.contains(b, F.lit("contrad")), "contradicho")
        .when(b.rlike("humana|revision|review"), "revision_humana").when(b.rlike("engañ|engan|mislead"), "enganoso").otherwise("sin_verificar")
    )


def verdict_matches(value: Column, needle: str) -> Column:
    """Either holds the other, or the value holds an alias of the needle. An empty value matches everything."""
    b, key = F.lower(F.coalesce(value, F.lit(""))), needle.strip().lower()
    out = F.contains(b, F.lit(key)) | F.contains(F.lit(key), b)
    for alias in VERDICT_ALIASES.get(key.replace(" ", "_"), ()):
        out = out | F.contains(b, F.lit(alias))
    return out


def stance_matches(value: Column, needle: str) -> Column:
    b, key = F.lower(F.coalesce(value, F.lit("Unknown"))), needle.strip().lower()
    if key in {"supported", "respaldado"}:
        return b.rlike("support|respald")
    if key in {"contradicted", "contradicho"}:
        return F.contains(b, F.lit("contrad"))
    if key in {"unknown", "sin_verificar", "sin verificar"}:
        return F.contains(b, F.lit("unknown")) | b.isin("", "sin verificar")
    return F.contains(b, F.lit(key))


@dataclass(frozen=True)
class ArticleQuery:
    """What to list: every field that is set narrows the result. risk_null overrides the two bounds."""

    source: str | None = None
    lang: str | None = None
    disease: str | None = None
    country: str | None = None
    stance: str | None = None
    raw_format: str | None = None
    text: str | None = None
    verdict: str | None = None
    origin: str | None = None
    min_risk: float | None = None
    max_risk: float | None = None
    risk_null: bool = False
    since: str | None = None
    until: str | None = None
    page: int = 1
    size: int = 12
    source_column: str = "source"

    @classmethod
    def parse(cls, **given) -> ArticleQuery:
        """From request parameters: blank is unset, size 1 to 400 (12 if it is no number), page from 1, limit is another name of size."""
        clean = {k: (v.strip() or None) if isinstance(v, str) else v for k, v in given.items()}

        def number(v, default: int) -> int:
            try:
                return int(v)
            except (TypeError, ValueError):
                return default

        size = number(clean.pop("limit", None) if clean.get("size") is None else clean.get("size"), 12)
        clean["size"], clean["page"] = min(400, max(1, size)), max(1, number(clean.get("page"), 1))
        clean["risk_null"] = str(clean.get("risk_null") or "").lower() in {"1", "true", "yes", "si", "sí"}
        return cls(**{k: v for k, v in clean.items() if k in cls.__dataclass_fields__})

    def condition(self) -> Column:
        """All conditions as one: columns source or source_id, lang, title, text, verdict, origin, risk, day, diseases (ids), country, nli, raw_format.

        A disease is named by its id, in any case and with spaces. An origin that is none filters nothing.
        """
        out = F.lit(True)
        for column, value in (("source", self.source), ("lang", self.lang), ("origin", origin_id(self.origin))):
            if value is not None:
                out = out & (F.col(column) == value)
        if self.disease is not None:
            out = out & F.array_contains("diseases", self.disease.lower().replace(" ", "_"))
        if self.country is not None:
            out = out & (F.upper("country") == self.country.upper())
        if self.stance is not None:
            out = out & stance_matches(F.col("nli"), self.stance)
        if self.raw_format is not None:
            out = out & (F.lower("raw_format") == self.raw_format.lower())
        if self.text is not None:
            out = out & F.contains(F.lower(F.concat_ws(" ", "title", "text", self.source_column)), F.lit(self.text.lower()))
        if self.verdict is not None:
            out = out & verdict_matches(F.col("verdict"), self.verdict)
        if self.risk_null:
            out = out & F.col("risk").isNull()
        else:
            out = out if self.min_risk is None else out & (F.col("risk") >= self.min_risk)
            out = out if self.max_risk is None else out & (F.col("risk") <= self.max_risk)
        out = out if self.since is None else out & (F.col("day") >= F.to_date(F.lit(self.since)))
        return out if self.until is None else out & (F.col("day") <= F.to_date(F.lit(self.until)))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of ordered rows: a top-k of number * size rows, not a sort of all."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def compare_ids(raw: Column) -> Column:
    """Ordered distinct ids of a comma-separated text."""
    return F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda s: F.trim(s)), lambda s: s != ""))
