"""The list of watched sources: made from a registry, due for a visit, used as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions import urls
from marisma.operators import numbering

# What tells the authority and the language of a source.
OFFICIAL = ("woah.org", "who.int", "fao.org", "cdc.gov", "gob.mx", "usda.gov", "paho.org")
GRADES = ("A", "B", "C", "D", "E", "F")
BY_SECTION = {"A": ("OFFICIAL",), "B": ("RESEARCH", "GENOMIC", "EPIDEMIOLOGICAL", "AGRICULTURAL", "FACT_CHECK"), "D": ("YOUTUBE",), "E": ("SOCIAL", "FORUM"), "C": ("NEWS", "AGGREGATOR")}
BY_CATEGORY = {"A": ("official",), "B": ("research", "veterinary", "surveillance"), "D": ("youtube",), "E": ("social", "forum"), "C": ("media",)}
SPANISH = ("MX", "ES", "AR", "CL", "CO", "PE")
ACCESS = ("api", "rss", "scrape", "web")


def first_domain(domains: Column, patterns: Column) -> Column:
    """The first domain, else the host part of the first pattern; empty without either."""
    own = F.lower(F.trim(F.get(domains, F.lit(0))))
    return F.coalesce(F.when(F.size(domains) > 0, own), F.when(F.size(patterns) > 0, F.split_part(F.lower(F.trim(F.get(patterns, F.lit(0)))), F.lit("/"), F.lit(1))), F.lit(""))


def access(declared: Column, rss: Column) -> Column:
    """How a source is read: as declared, by its feed where there is one ("api" and "scrape" give way to it too), else page by page."""
    low, has = F.lower(F.coalesce(declared, F.lit(""))), F.coalesce(rss, F.lit("")) != ""
    return F.when(has, "rss").when(low == "web", "scrape").when(low.isin(*ACCESS), low).otherwise("scrape")


def authority(stated: Column, domain: Column, section: Column, category: Column) -> Column:
    """Grade of a source: as stated, by an official domain, by its section or its category; empty where nothing tells it."""
    grade, section = F.upper(F.trim(F.coalesce(stated, F.lit("")))), F.upper(F.coalesce(section, F.lit("")))
    category = F.coalesce(category, F.lit(""))
    out = F.when(grade.isin(*GRADES), grade).when(urls.under(domain, OFFICIAL), "A")
    for name in ("A", "B"):
        out = out.when(section.isin(*BY_SECTION[name]), name)
    for name in ("A", "B"):
        out = out.when(category.isin(*BY_CATEGORY[name]), name)
    for name in ("D", "E", "C"):
        out = out.when(section.isin(*BY_SECTION[name]) | category.isin(*BY_CATEGORY[name]), name)
    return out.otherwise("")


def language(stated: Column, country: Column) -> Column:
    own = F.trim(F.split_part(stated, F.lit(","), F.lit(1)))
    return F.when(F.coalesce(stated, F.lit("")) != "", own).when(F.upper(F.coalesce(country, F.lit(""))).isin(*SPANISH), "es").otherwise("und")


def generated(items: DataFrame, order: str) -> DataFrame:
    """Sources of a registry (domains, patterns, name, country, language, access_method, rss_url, source_authority, section, category): the first item by order of each domain, numbered SRC001, SRC002, ... in that order.

    The first item of a domain is found by an aggregate, and numbers come from counts of ranges (numbering.numbered). Items without a domain are none.
    """
    rows = items.withColumn("domain", first_domain(F.col("domains"), F.col("patterns"))).where("domain <> ''")
    rest = [c for c in rows.columns if c not in ("domain", order)]
    first = rows.groupBy("domain").agg(F.min_by(F.struct(order, *rest), order).alias("r")).select("domain", "r.*")
    placed = numbering.numbered(first, [F.col(order)], "_number")
    number = F.col("_number").cast("string")
    return placed.select(
        F.concat(F.lit("SRC"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("source_id"), F.coalesce("name", "domain").alias("name"), "domain", F.coalesce("country", F.lit("INT")).alias("country"),
        language(F.col("language"), F.col("country")).alias("language"), access(F.col("access_method"), F.col("rss_url")).alias("access_method"), authority(F.col("source_authority"), F.col("domain"), F.col("section"), F.col("category")).alias("authority"),
        F.when(F.coalesce("rss_url", F.lit("")) != "", "none").otherwise("html").alias("scraper_type"),
    )


def due_in_turn(due: DataFrame, method: str, order: str, scrapes: int = 10) -> DataFrame:
    """The sources of one cycle: all that are read by feed or interface, and of those that are read page by page the first `scrapes`, which come last: adds late (false, true)."""
    quick = due.where(F.coalesce(F.col(method), F.lit("scrape")) != "scrape").withColumn("late", F.lit(False))
    slow = due.where(F.coalesce(F.col(method), F.lit("scrape")) == "scrape").orderBy(order).limit(max(0, scrapes)).withColumn("late", F.lit(True))
    return quick.unionByName(slow)


def evidence_uses(sources: DataFrame, domain: str, hosts: DataFrame, host: str, n: str) -> DataFrame:
    """sources with uses: the largest count of a host that is its domain, lies under it or above it; 0 without one.

    Both ways are equality joins: every suffix of a host with the domain, every suffix of the domain with the host.
    """
    name = F.regexp_replace(F.lower(F.coalesce(F.col(domain), F.lit(""))), r"^www\.", "")
    own = sources.select(name.alias("_domain")).where("_domain <> ''").distinct()
    counts = hosts.groupBy(F.lower(F.col(host)).alias("_host")).agg(F.max(n).alias("_n")).where("_host <> ''")
    below = counts.select("_n", F.explode(urls.suffixes(F.col("_host"))).alias("_domain")).join(own, "_domain")
    above = own.select("_domain", F.explode(urls.suffixes(F.col("_domain"))).alias("_host")).join(counts, "_host").select("_n", "_domain")
    most = below.select("_n", "_domain").union(above).groupBy("_domain").agg(F.max("_n").alias("_uses"))
    return sources.withColumn("_name", name).join(most, F.col("_name") == F.col("_domain"), "left").select(*sources.columns, F.coalesce("_uses", F.lit(0)).cast("bigint").alias("uses"))


def narrative_growth(asked: DataFrame, key: str, needles: str, narratives: DataFrame, label: str, keywords: str, growth: str) -> DataFrame:
    """key, growth: the largest growth of the narratives whose label or keywords hold one of a row's needles (an array; "_" counts as a space), of all where it has none; at least 0.

    Needles become an automaton that reads each narrative once (gazetteer.mentions); a row and a narrative meet by the needle found.
    """
    from marisma.operators import gazetteer

    wanted = asked.select(F.col(key), F.explode(F.filter(F.transform(F.col(needles), lambda x: F.replace(F.lower(x), F.lit("_"), F.lit(" "))), lambda x: x != "")).alias("needle"))
    terms = wanted.select(F.col("needle").alias("term"), F.col("needle").alias("canonical"), F.lit("needle").alias("kind"), F.lit(None).cast("string").alias("edge")).distinct()
    blob = F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(F.col(keywords).cast("string"), F.lit("")))
    value = F.col(growth).cast("double")
    by_needle = gazetteer.mentions(narratives.withColumn("_growth", value), "_growth", blob, terms).groupBy(F.col("canonical").alias("needle")).agg(F.max("_growth").alias("g"))
    best = wanted.join(by_needle, "needle").groupBy(key).agg(F.max("g").alias("g"))
    overall = narratives.agg(F.max(value).alias("every"))
    out = asked.select(key, needles).join(best, key, "left").crossJoin(F.broadcast(overall))
    none = F.size(F.filter(F.coalesce(F.col(needles), F.array().cast("array<string>")), lambda x: x != "")) <= 0
    return out.select(key, F.greatest(F.lit(0.0), F.when(none, F.coalesce("every", F.lit(0.0))).otherwise(F.coalesce("g", F.lit(0.0)))).alias("growth"))
