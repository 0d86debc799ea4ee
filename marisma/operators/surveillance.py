"""What a narrative is like: how much, where, when and by whom, from one pass over its articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.operators import facets, narratives

# The country of articles without one, the source of those without one, and when a narrative counts as growing.
NO_COUNTRY, NO_SOURCE, GROWING = "XX", "desconocida", 40
ACTIVE = ("crecimiento", "pico", "aparicion", "propagacion")


def growth(counts: Column) -> Column:
    """Percent by which the second half of a series exceeds the first; 100 for one of fewer than four days."""
    half = F.floor(F.size(counts) / 2).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    first, second = total(F.slice(counts, 1, half)), total(F.slice(counts, half + 1, F.size(counts)))
    first = F.when(first == 0, 1).otherwise(first)
    return F.when(F.size(counts) >= 4, F.round((second - first) * 100.0 / first, 1)).otherwise(F.lit(100.0))


def characterize(rows: DataFrame, group: str, key: str, day: str, country: str, source: str, name: str, most: int = 12) -> DataFrame:
    """One row for each narrative (`group`) of the table of its articles (group, key, day, country, source, name).

    volume, first_seen, last_seen, growth, stage, peak_day, country_n, sources_n; series (day, n), countries (country, n, first_seen, sources, peak_day), sources
    (source, name, country, n, first_seen, last_seen; the `most` with most articles) and articles (the first `most` keys). Of equal counts that comes first whose first article does.

    Articles are exchanged once, as counts of (group, country, source, day); every other figure comes from grouping sets over these counts,
    whose number is that of countries, sources and days and not of articles. Articles without a day count, but for no day; an empty table gives none.
    """
    named = F.coalesce(F.nullif(F.col(source), F.lit("")), F.nullif(F.col(name), F.lit("")), F.lit(NO_SOURCE))
    rows = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(day).alias("d"), F.coalesce(F.nullif(F.col(country), F.lit("")), F.lit(NO_COUNTRY)).alias("c"), named.alias("s"), F.coalesce(F.nullif(F.col(name), F.lit("")), named).alias("name"))
    cells = rows.groupBy("g", "c", "s", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "name", F.col("c").alias("own"))).alias("first"))
    g, c, s, d = (F.col(x) for x in "gcsd")
    cube = cells.groupingSets([[g], [g, c], [g, s], [g, d], [g, c, d], [g, c, s]], "g", "c", "s", "d").agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), F.min("first").alias("first"), F.min(F.col("d")).alias("since"), F.max(F.col("d")).alias("until"))
    whole, by_country, by_source, by_day, country_day, country_source = 0b0111, 0b0011, 0b0101, 0b0110, 0b0010, 0b0001
    at = lambda *levels: F.col("level").isin(*levels)

    order = F.struct((-F.col("n")).alias("m"), F.col("first.k").alias("k"))
    places = cube.where(at(by_country, country_day, country_source)).groupBy("g", "c").agg(
        F.max(F.when(at(by_country), F.col("n"))).alias("n"), F.min(F.when(at(by_country), F.col("first.k"))).alias("k"), F.min(F.when(at(by_country), F.col("since"))).alias("first_seen"),
        F.count_if(at(country_source)).alias("sources"), F.min_by("d", F.when(at(country_day) & F.col("d").isNotNull(), order)).alias("peak_day"),
    )
    ranked = lambda *cells: F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "k", *cells)))
    places = places.groupBy("g").agg(ranked("c", "n", "first_seen", "sources", "peak_day").alias("countries"))

    sources = cube.where(at(by_source)).select("g", "s", "n", F.col("first.k").alias("k"), F.col("first.name").alias("name"), F.col("first.own").alias("country"), "since", "until")
    n_sources = sources.groupBy("g").agg(F.count(F.lit(1)).alias("sources_n"))
    sources = facets.top_per_group(sources, ["g"], [F.desc("n"), F.col("k")], most).groupBy("g").agg(ranked("s", "name", "country", "n", "since", "until").alias("sources"))

    days = cube.where(at(by_day) & F.col("d").isNotNull()).select("g", "d", "n")
    series = days.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(F.col("d").alias("day"), "n"))).alias("series"))
    stages = narratives.lifecycle(days, "g", "d", "n")
    first = facets.top_per_group(rows.select("g", "k"), ["g"], [F.col("k")], most).groupBy("g").agg(F.array_sort(F.collect_list("k")).alias("articles"))

    out = cube.where(at(whole)).select("g", F.col("n").alias("volume"), F.col("since").alias("first_seen"), F.col("until").alias("last_seen"))
    for part in (places, n_sources, sources, series, stages, first):
        out = out.join(part, "g", "left")
    fields = lambda x, names: F.transform(x, lambda r: F.struct(*[r[n].alias(m) for n, m in names.items()]))
    counts = F.coalesce(F.transform("series", lambda r: r["n"]), F.array().cast("array<bigint>"))
    return out.select(
        F.col("g").alias(group), "volume", "first_seen", "last_seen", growth(counts).alias("growth"), F.coalesce("stage", F.lit("origen")).alias("stage"), "peak_day",
        F.size(F.filter("countries", lambda r: r["c"] != NO_COUNTRY)).cast("bigint").alias("country_n"), "sources_n", "series",
        fields("countries", {"c": "country", "n": "n", "first_seen": "first_seen", "sources": "sources", "peak_day": "peak_day"}).alias("countries"),
        fields("sources", {"s": "source", "name": "name", "country": "country", "n": "n", "since": "first_seen", "until": "last_seen"}).alias("sources"), "articles",
    )


def kpis(narratives_: DataFrame) -> DataFrame:
    """Figures over all narratives, one row: narratives, active, growing, countries."""
    alone = narratives_.select("volume", "stage", "growth", F.transform("countries", lambda r: r["country"]).alias("cs"))
    counts = alone.agg(F.count(F.lit(1)).alias("narratives"), F.count_if(F.col("stage").isin(*ACTIVE)).alias("active"), F.count_if(F.col("growth") >= GROWING).alias("growing"))
    places = alone.select(F.explode("cs").alias("c")).where(F.col("c") != NO_COUNTRY).agg(F.countDistinct("c").alias("countries"))
    return counts.crossJoin(places)
