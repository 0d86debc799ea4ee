"""What the routes of the application return, each as one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.operators import articles, facets, filters

# Tranches of risk as charts show them; the last one is for articles without a score.
TRANCHES = ("0-20", "21-40", "41-60", "61-80", "81-100", "sin_puntuacion")
# How many articles of a graph are nodes, at least and at most, how many sources stay, how long a title is.
ARTICLE_NODES, SOURCES, TITLE = (10, 80), 28, 42


def one(**parts: DataFrame) -> DataFrame:
    """One row with each part as an array of its rows, in the order of its columns. Parts are small: a row for each facet, day or place."""
    out = None
    for name, part in parts.items():
        row = part.agg(F.coalesce(F.array_sort(F.collect_list(F.struct(*part.columns))), F.array().cast(f"array<{part.schema.simpleString()}>")).alias(name))
        out = row if out is None else out.crossJoin(row)
    return out


def tranche(risk: Column) -> Column:
    return F.when(risk.isNull(), TRANCHES[-1]).otherwise(facets.buckets(risk))


def chart(rows: DataFrame, key: str, diseases: Sequence[str], verdicts: Sequence[str]) -> DataFrame:
    """The charts of articles (key, day, title, risk, verdict, nli, origin, diseases) in one row: n, empty, volume_by_verdict, volume_by_origin, volume_by_disease, by_day, risk_histogram, risk_note, stance.

    All counts by a key come from one pass; days from a second one with their first titles.
    """
    nli = F.when(F.col("nli").isin("Supported", "Contradicted"), F.col("nli")).otherwise("Unknown")
    wanted = {
        "verdict": (F.array(filters.verdict_key(F.col("verdict"))), tuple(verdicts)), "origin": (F.array("origin"), filters.ORIGINS), "disease": (F.when(F.size("diseases") > 0, F.col("diseases")).otherwise(F.array(F.lit("otras"))), (*diseases, "otras")),
        "risk": (F.array(tranche(F.col("risk"))), TRANCHES), "stance": (F.array(nli), ("Supported", "Contradicted", "Unknown")),
    }
    counts = articles.facets(rows, wanted)
    place = F.create_map(*[c for facet, (_, keys) in wanted.items() for i, k in enumerate(keys) for c in (F.lit(f"{facet}:{k}"), F.lit(i))])
    counts = counts.withColumn("place", F.element_at(place, F.concat_ws(":", "facet", "key")))
    # one aggregate for all facets: a filter by facet would read the articles again for each
    cell = F.struct("place", "key", "n")
    listed = lambda facet: F.array_sort(F.collect_list(F.when(F.col("facet") == facet, cell)))
    named = {"volume_by_verdict": "verdict", "volume_by_origin": "origin", "volume_by_disease": "disease", "risk_histogram": "risk", "stance": "stance"}
    counts = counts.agg(*[listed(facet).alias(c) for c, facet in named.items()])
    days = articles.daily(rows, "day", key, "title", "risk").select("day", "n", "unknown_risk", "alerts", "mean_risk", "titles")
    out = counts.crossJoin(one(by_day=days))
    n = F.aggregate("volume_by_verdict", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    scored = F.filter("risk_histogram", lambda b: (b["key"] != TRANCHES[-1]) & (b["n"] > 0))
    top = F.array_sort(F.transform(scored, lambda b: F.struct((-b["n"]).alias("m"), b["place"].alias("place"), b["key"].alias("key"))))
    note = F.when(F.size(top) > 0, F.concat(F.lit("El tramo de riesgo más común es "), top[0]["key"], F.lit(".")))
    return out.withColumns({"n": n, "empty": n == 0, "risk_note": note})


def listing(rows: DataFrame, condition: Column, order: Sequence[Column], page: int, size: int, columns: Sequence[str], facet: str) -> DataFrame:
    """A page of articles in one row: total, page, pages, items (in their order) and counts by a facet of all that the condition holds for."""
    some = rows.where(condition)
    turn = filters.page(some, list(order), page, size)
    turn = turn.select(F.row_number().over(Window.orderBy(*order)).alias("turn"), *columns)  # of one page
    counts = some.groupBy(F.col(facet).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return one(items=turn, counts=counts).withColumn("total", total).withColumns({"page": F.lit(page), "pages": F.ceil(F.col("total") / size)})


def network(rows: DataFrame, key: str, narratives: DataFrame, limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, group, value) and edges (a, b, label) of articles (key, title, source, diseases) and narratives (id, label, value, and key of each article that one of its words is in).

    Sources and diseases weigh by articles; the first articles, at most `limit` within ARTICLE_NODES, are nodes of their own; of the sources the SOURCES with most articles stay. An
    edge stands once; it is labelled by what links its ends first: a source publishes, speaks of, an article mentions, a disease enters a narrative.
    """
    few = max(ARTICLE_NODES[0], min(ARTICLE_NODES[1], limit))
    rows = rows.select(F.col(key).alias("k"), "title", F.coalesce(F.nullif("source", F.lit("")), F.lit("desconocido")).alias("s"), F.coalesce("diseases", F.array().cast("array<string>")).alias("ds"))
    hits = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    top = hits.orderBy(F.desc("n"), "first").limit(SOURCES)
    kept = rows.join(F.broadcast(top.select("s")), "s", "left_semi")
    shown = rows.orderBy("k").limit(few)
    tags = rows.select("k", "s", F.explode("ds").alias("d"))
    dis, src = (lambda c: F.concat(F.lit("DIS-"), c)), (lambda c: F.concat(F.lit("SRC-"), c))
    node = lambda t, i, label, group, value: t.select(i.alias("id"), label.alias("label"), F.lit(group).alias("group"), value.cast("bigint").alias("value"))
    nodes = node(top, src(F.col("s")), F.col("s"), "source", F.col("n")).union(node(shown, F.col("k").cast("string"), F.coalesce(F.substring("title", 1, TITLE), F.col("k").cast("string")), "article", F.lit(2)))
    nodes = nodes.union(node(tags.groupBy("d").agg(F.count(F.lit(1)).alias("n")), dis(F.col("d")), F.col("d"), "disease", F.col("n")))
    nodes = nodes.union(node(narratives.select("id", "label", "value").distinct(), F.col("id"), F.col("label"), "narrative", F.col("value")))
    edge = lambda t, a, b, label, turn: t.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.struct(F.lit(turn).alias("turn"), F.lit(label).alias("label")).alias("e"))
    id_ = F.col("k").cast("string")
    told = narratives.select("id", F.col(key).alias("k")).distinct().join(rows, "k").select("id", "s", F.explode_outer("ds").alias("d"))
    every = edge(shown.join(F.broadcast(top.select("s")), "s", "left_semi"), id_, src(F.col("s")), "publicó", 0)
    every = every.union(edge(tags.join(kept.select("s").distinct(), "s", "left_semi"), src(F.col("s")), dis(F.col("d")), "habla de", 1)).union(edge(shown.select("k", F.explode("ds").alias("d")), id_, dis(F.col("d")), "menciona", 2))
    every = every.union(edge(told.where("d is not null"), dis(F.col("d")), F.col("id"), "entra en", 3)).union(edge(told.where("d is null").join(top.select("s"), "s", "left_semi"), src(F.col("s")), F.col("id"), "alimenta", 4))
    edges = every.where("a <> b").groupBy("a", "b").agg(F.min("e").alias("e")).select("a", "b", F.col("e.label").alias("label"))
    return nodes, edges
