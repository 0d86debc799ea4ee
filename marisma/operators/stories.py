"""Narratives: what they are called, which articles belong to one, what is near an article."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.operators import facets, relations

#: Countries that stand for none.
NOWHERE = ("", "XX", "INT")
#: Lists of untagged articles, and of all of them.
NONE, ALL = "-", "*"


def narrative(labels: Column, structures: Column, hidden: Column) -> Column:
    """The state of a narrative from the labels of its claims, the number of story structures, and whether hiding is asserted."""
    of = lambda v: (
        F.when(F.contains(F.lower(v), F.lit("contrad")), "contradicha").when(F.lower(v).rlike("support|respald"), "respaldada").when(F.lower(v).rlike("engañ|misleading"), "potencialmente_engañosa")
        .when(F.lower(v).rlike("revis|hitl"), "prioridad_investigacion").otherwise("no_verificable")
    )
    k = F.transform(labels, lambda v: of(F.coalesce(v, F.lit(""))))
    against = F.size(F.filter(k, lambda v: v == "contradicha"))
    most = (against > 0) & (against >= F.greatest(F.lit(1), F.floor(F.size(k) / 2)))
    backed = F.array_contains(k, "respaldada")
    return (
        F.when(most, "contradicha").when(backed & (against == 0) & (structures == 0), F.when(F.size(F.array_distinct(k)) > 1, "parcial").otherwise("respaldada"))
        .when(hidden & (structures >= 1) & ~backed, "prioridad_investigacion").when(F.array_contains(k, "potencialmente_engañosa"), "potencialmente_engañosa").otherwise("no_verificable")
    )


def matches(rows: DataFrame, key: str, specs: Mapping[str, tuple[Sequence[str], Sequence[str]]], low: str, categories: str, strong: str, structures: str) -> DataFrame:
    """narrative, key for every spec (needed categories, extra terms) that a row fits: all or some of the categories with an extra term
    where there are any; or some of them with a heavy hit or a structure. A spec without categories fits nothing.
    """
    tests = []
    for name, (need, extra) in specs.items():
        wanted = F.array(*[F.lit(c) for c in need]).cast("array<string>")
        told = F.lit(True)
        if extra:
            told = F.lit(False)
            for t in extra:
                told = told | F.contains(F.col(low), F.lit(t.lower()))
        some = F.arrays_overlap(F.col(categories), wanted)
        fits = told & (F.size(wanted) > 0) & ((F.size(F.array_except(wanted, F.col(categories))) == 0) | some | (some & (F.col(strong) | F.col(structures))))
        tests.append(F.when(fits, name))
    return rows.select(F.explode_outer(F.array_compact(F.array(*tests))).alias("narrative"), key).where("narrative is not null")


def peers(anchors: DataFrame, rows: DataFrame, key: str, country: str, tags: str, day: str, days: int = 7, most: int = 24) -> DataFrame:
    """Articles near each anchor: of its country (any, where it has none), with one of its tags if both have tags, within some days if both
    have one; newest first, undated ones last, at most `most`.

    Rows are listed for each country and for all, by each tag, as untagged and for all tags; an anchor looks into the lists that hold its like and takes the
    newest of each (relations.newest), an undated one the newest of all. Of the undated rows of a list only the first can count and are joined.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("bigint")
    tag = lambda missing, rest: F.when(F.size(tags) > 0, F.array_union(F.col(tags), F.array(*[F.lit(x) for x in rest]))).otherwise(F.array(*[F.lit(x) for x in missing]))
    known = ~F.upper(F.coalesce(country, F.lit(""))).isin(*NOWHERE)
    named = lambda c, t: F.concat_ws("\x1f", c, t)
    a = anchors.select(F.col(key).alias("anchor"), F.when(known, F.upper(country)).otherwise("*").alias("c"), number.alias("at"), F.explode(tag([ALL], [NONE])).alias("tag"))
    a = a.select("anchor", named("c", "tag").alias("g"), F.coalesce(F.col("at") - days, F.lit(-(1 << 40))).alias("since"), F.coalesce(F.col("at") + days, F.lit(1 << 40)).alias("until"))
    b = rows.select(F.col(key).alias("peer"), number.alias("t"), F.explode(F.array_distinct(F.array(F.upper(F.coalesce(country, F.lit(""))), F.lit("*")))).alias("c"), tag([NONE, ALL], [ALL]).alias("tags"))
    b = b.select("peer", "t", "c", F.explode("tags").alias("tag")).select(named("c", "tag").alias("g"), "t", "peer")
    dated = relations.newest(a, b.where("t is not null"), most, 1)
    undated = facets.top_per_group(b.where("t is null"), ["g"], [F.col("peer")], most + 1).select("g", "peer", "t")
    near = dated.union(a.select("anchor", "g").join(undated, "g").where("anchor <> peer").select("anchor", "peer", "t")).distinct()
    turn = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc_nulls_last("t"), "peer"))
    return near.withColumn("turn", turn).where(F.col("turn") <= most).select("anchor", "peer", "turn")


def similar(queries: DataFrame, rows: DataFrame, key: str, tags: str, digest: str, source: str, most: int) -> DataFrame:
    """The rows most like each query: 4 for each shared tag, 8 for an equal image hash, 1 for the same source; ties by key.

    What a row scores depends on its tags and on whether its hash and its source are the query's. So of rows with equal tags, and where these count
    an equal hash or source, only the first most + 1 matter: one row more than `most` since a query is no match of itself, and those of another source
    that give way to one of the query's own would have come after it. Each such list is cut before it is joined, by the keys that it shares with queries; what
    a query meets does not grow with the number of rows or sources.
    """
    own, none = F.array_join(F.array_sort(tags), "|"), F.lit("").alias("b")
    all_rows = rows.select(F.col(key).alias("match"), F.col(tags).alias("y"), F.col(digest).alias("h"), F.col(source).alias("s"), own.alias("t"))
    text = lambda c: F.col(c).cast("string")

    def first(of: DataFrame, *group: str) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy(*group).orderBy("match"))
        return of.withColumn("turn", turn).where(F.col("turn") <= most + 1).drop("turn")

    hts = first(all_rows, "h", "t", "s")
    ht, ts = first(hts, "h", "t"), first(hts, "t", "s")
    held = ("match", "y", "h", "s")
    few = hts.select(*held, F.lit(0).alias("kind"), text("h").alias("a"), text("s").alias("b"))
    few = few.union(ht.select(*held, F.lit(1), text("h"), none))
    few = few.union(ts.select(*held, F.lit(2), F.explode(F.col("y").cast("array<string>")), text("s")))
    few = few.union(first(ht, "t").select(*held, F.lit(3), F.explode(F.col("y").cast("array<string>")), none))
    few = few.union(first(ts, "s").select(*held, F.lit(4), text("s"), none))
    cell = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("a"), b.cast("string").alias("b"))
    h, s = F.col(digest), F.col(source)
    alone = F.array(cell(0, h, s), cell(1, h, F.lit("")), cell(4, s, F.lit("")))
    each = F.coalesce(F.col(tags).cast("array<string>"), F.array().cast("array<string>"))
    tagged = [F.transform(each, lambda y: cell(2, y, s)), F.transform(each, lambda y: cell(3, y, F.lit("")))]
    q = queries.select(F.col(key).alias("query"), F.col(tags).alias("x"), h.alias("qh"), s.alias("qs"), F.explode(F.concat(alone, *tagged)).alias("on")).select("query", "x", "qh", "qs", "on.*")
    pairs = q.join(few, ["kind", "a", "b"]).where(F.col("query") != F.col("match"))
    score = 4 * F.size(F.array_intersect("x", "y")) + F.when(F.col("qh") == F.col("h"), 8).otherwise(0) + F.when(F.col("qs") == F.col("s"), 1).otherwise(0)
    found = pairs.select("query", "match", score.cast("int").alias("score"))
    turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "match"))
    return found.distinct().withColumn("turn", turn).where(F.col("turn") <= most).select("query", "match", "score")


def stages(rows: DataFrame, key: str, day: str, most: int) -> DataFrame:
    """Up to `most` stretches of equal size in time, what is left over in the last: turn, the smallest key, day_from, day_to, publications.

    Counts of days tell where each day begins; rows are numbered inside their day alone.
    """
    n = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    start = n.select(day, (F.sum("n").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("start"))
    total = n.agg(F.sum("n").alias("total"))
    placed = rows.select(day, key, F.row_number().over(Window.partitionBy(day).orderBy(key)).alias("i")).join(F.broadcast(start), day).crossJoin(F.broadcast(total))
    parts = F.least(F.lit(most), F.col("total"))
    turn = F.least(F.floor((F.col("start") + F.col("i") - 1) / F.greatest(F.lit(1), F.floor(F.col("total") / parts))), parts - 1) + 1
    out = placed.select(turn.cast("int").alias("turn"), key, day).groupBy("turn")
    return out.agg(F.min(key).alias(key), F.min(day).alias("day_from"), F.max(day).alias("day_to"), F.count(F.lit(1)).alias("publications"))
