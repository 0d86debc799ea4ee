"""What the listing, the charts, the map and the figures of articles show, as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.operators import filters

# From which risk on an article is an alert, and verdicts that are one.
ALERT = 55
ALERT_VERDICTS = ("contradicho", "engañoso", "revisión humana")


def prepared(rows: DataFrame) -> DataFrame:
    """Adds origin to judged articles (url, kind, raw_format, title, text)."""
    return rows.withColumn("origin", filters.origin(F.col("url"), F.concat_ws(" ", "kind", "raw_format"), F.concat_ws(" ", "title", "text")))


def shown() -> Column:
    """Articles off the topic are not listed; fixtures and the corpus always are."""
    return F.lower(F.coalesce("raw_format", F.lit(""))).isin("fixture", "corpus") | ~F.col("skip")


def facets(rows: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """facet, key, n for every wanted key, zero where no row has it. Each facet is an array of a row's keys; all are counted in one pass."""
    def named(facet: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(facet).alias("facet"), k.alias("key")))

    cells = F.flatten(F.array(*[named(f, keys) for f, (keys, _) in wanted.items()]))
    n = rows.select(F.explode_outer(cells).alias("c")).where("c is not null").groupBy("c.facet", "c.key").agg(F.count(F.lit(1)).alias("n"))
    spine = rows.sparkSession.createDataFrame([(f, k) for f, (_, keys) in wanted.items() for k in keys], "facet string, key string")
    return spine.join(n, ["facet", "key"], "left").select("facet", "key", F.coalesce("n", F.lit(0)).alias("n"))


def daily(rows: DataFrame, day: str, key: str, title: str, risk: str, titles: int = 3) -> DataFrame:
    """One row for each day from the first to the last: articles, those of unknown risk, alerts, mean risk, the first titles."""
    got = rows.groupBy(day).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(risk).isNull()).alias("unknown_risk"), F.count_if(F.col(risk) >= ALERT).alias("alerts"), F.round(F.avg(risk), 1).alias("mean_risk"),
    )
    # a bounded list of titles: ids are ranked by an aggregate of each day and partition first
    from marisma.operators.facets import top_per_group

    first = top_per_group(rows.select(day, key, title), [day], [F.col(key)], titles).groupBy(day).agg(F.array_sort(F.collect_list(F.struct("turn", title))).alias("t"))
    ends = rows.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    spine = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias(day))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    none = F.array().cast("array<string>")
    return spine.join(got, day, "left").join(first, day, "left").select(day, zero("n"), zero("unknown_risk"), zero("alerts"), "mean_risk", F.coalesce(F.transform("t", lambda x: x[title]), none).alias("titles"))


def by_country(rows: DataFrame, country: str, day: str, risk: str, diseases: str) -> DataFrame:
    """A row of the map for each country: articles, alerts, first day as text, radius, diseases by count."""
    n = rows.groupBy(country).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(risk) >= ALERT).alias("alerts"), F.date_format(F.min(day), "yyyy-MM-dd").alias("first_seen"))
    own = F.when(F.size(diseases) > 0, F.col(diseases)).otherwise(F.array(F.lit("otras")))
    c = rows.select(country, F.explode_outer(own).alias("dis")).groupBy(country, "dis").agg(F.count(F.lit(1)).alias("k"))
    lists = c.groupBy(country).agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("m"), "dis"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["dis"], (-x["m"]).cast("string"))), "|")
    return n.join(lists, country).crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).select(country, "n", "alerts", "first_seen", F.round(F.sqrt(F.col("n") / F.col("most")), 4).alias("radius"), text.alias("diseases"))


def kpis(rows: DataFrame) -> DataFrame:
    """The figures of the start page in one pass: what, n."""
    alert = (F.coalesce("risk", F.lit(0)) >= ALERT) | F.lower("verdict").isin(*ALERT_VERDICTS)
    n = rows.agg(
        F.count(F.lit(1)).alias("articles"), F.count_if(alert).alias("alerts"), F.count_if(F.col("nli").isin("Unknown", "")).alias("unverified"), F.countDistinct("source_id").alias("sources"), F.count_if(~F.col("skip")).alias("relevant"),
    )
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in n.columns])).alias("r")).select("r.*")
