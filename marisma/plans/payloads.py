"""Queries of what routes return as one result."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.functions import facts
from marisma.operators import filters, payloads
from marisma.plans import articles as base
from marisma.plans.articles import _IDS, _KEYS, _LISTED, _named, _sql_list, articles
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _told(x, *names):
    cell = lambda r: F.concat_ws(":", *[F.coalesce(r[n].cast("string"), F.lit("-")) for n in names])
    return F.array_join(F.transform(x, cell), ",")


_TRANCHE = "case when risk is null then 'sin_puntuacion' when risk <= 20 then '0-20' when risk <= 40 then '21-40' when risk <= 60 then '41-60' when risk <= 80 then '61-80' else '81-100' end"
_STANCE = "case when nli in ('Supported', 'Contradicted') then nli else 'Unknown' end"


def _counts(of: str, keys) -> str:
    return f"(select string_agg(k || ':' || coalesce(n, 0), ',' order by i) from (select unnest({_sql_list(keys)}) as k, unnest(range({len(keys)})) as i) left join (select {of} as k, count(*) as n from l group by 1) using (k))"


@query(f"""with l as (select * from {_LISTED}), v as ({base.SQL['chart_facets']}), d as ({base.SQL['chart_daily']}), r as (select {_TRANCHE} as t, count(*) as n from l where risk is not null group by 1)
select (select count(*) from l)::bigint as n, false as empty, (select string_agg(key || ':' || n, ',' order by list_position({_sql_list(_KEYS)}, key)) from v where facet = 'verdict') as volume_by_verdict,
 (select string_agg(key || ':' || n, ',' order by list_position({_sql_list(filters.ORIGINS)}, key)) from v where facet = 'origin') as volume_by_origin, (select string_agg(key || ':' || n, ',' order by list_position({_sql_list([*_IDS, 'otras'])}, key)) from v where facet = 'disease') as volume_by_disease,
 {_counts(_TRANCHE, payloads.TRANCHES)} as risk_histogram, {_counts(_STANCE, ('Supported', 'Contradicted', 'Unknown'))} as stance, (select string_agg(day || ':' || n || ':' || unknown_risk || ':' || alerts || ':' || coalesce(mean_risk::varchar, '-'), ',' order by day) from d) as by_day,
 'El tramo de riesgo más común es ' || (select t from r order by n desc, list_position({_sql_list(payloads.TRANCHES)}, t) limit 1) || '.' as risk_note""")
def chart_payload(spark, d):
    """All charts of the articles in one row."""
    out = payloads.chart(base._listed(spark, d, shown=False), "doc_id", list(_IDS), _KEYS)
    counts = {c: _told(c, "key", "n") for c in ("volume_by_verdict", "volume_by_origin", "volume_by_disease", "risk_histogram", "stance")}
    return out.withColumns({**counts, "by_day": _told("by_day", "day", "n", "unknown_risk", "alerts", "mean_risk")})


@query(f"""with a as (select * from {_LISTED} where (raw_format in ('fixture', 'corpus') or not skip) and risk >= 20), p as (select doc_id, row_number() over (order by day desc, doc_id) as turn from a qualify turn > 10 and turn <= 20)
select (select count(*) from a)::bigint as total, 2 as page, ceil((select count(*) from a) / 10.0)::bigint as pages, (select string_agg(doc_id::varchar, ',' order by turn) from p) as items, (select string_agg(origin || ':' || n, ',' order by origin) from (select origin, count(*) as n from a group by 1)) as counts""")
def articles_payload(spark, d):
    """The second page of a listing, and how many articles of each origin there are."""
    from marisma.operators import articles as listing

    rows = base._listed(spark, d)
    q = filters.ArticleQuery.parse(min_risk=20)
    out = payloads.listing(rows, q.condition() & listing.shown(), [F.desc("day"), F.col("doc_id")], 2, 10, ["doc_id"], "origin")
    return out.withColumns({"items": _told("items", "doc_id"), "counts": _told("counts", "key", "n")})


_WORDS = {"N-texas": "texas", "N-vacuna": "vacuna", "N-ocult": "ocult"}
_NARRATED = "(" + " union all ".join(f"select '{i}' as id, '{w}' as label, 5 as value, doc_id as k from a where contains(lower(title || ' ' || text), '{w}')" for i, w in _WORDS.items()) + ")"
_GRAPH = f"""a as (select doc_id, title, text, coalesce(nullif(source_id, ''), 'desconocido') as s, {_named('lower(title)', _IDS)} as ds from {base.ARTICLES}), top as (select s, count(*) as n from a group by s order by count(*) desc, min(doc_id) limit 28),
shown as (select * from a order by doc_id limit 40), tags as (select doc_id as k, s, unnest(ds) as d from a), n as (select * from {_NARRATED}), told as (select n.id, a.s, a.ds, a.doc_id from n join a on a.doc_id = n.k)"""


def _network(spark, d):
    a = articles(spark, d)
    rows = a.select("doc_id", "title", F.col("source_id").alias("source"), facts.canonical(F.lower("title"), _IDS).alias("diseases"))
    low = F.lower(F.concat_ws(" ", "title", "text"))
    named = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.struct(F.lit(i).alias("id"), F.lit(w).alias("label"), F.lit(5).alias("value"))) for i, w in _WORDS.items()]))
    told = a.select("doc_id", F.explode(named).alias("n")).select("n.*", "doc_id")
    return payloads.network(rows, "doc_id", told, 40)


@query(f"""with {_GRAPH} select 'SRC-' || s as id, s as label, 'source' as group, n::bigint as value from top union all select doc_id::varchar, substr(title, 1, 42), 'article', 2 from shown union all select 'DIS-' || d, d, 'disease', count(*)::bigint from tags group by d union all select distinct id, label, 'narrative', 5::bigint from n""")
def network_nodes(spark, d):
    """Nodes of the graph of sources, articles, diseases and narratives."""
    return _network(spark, d)[0]


@query(f"""with {_GRAPH}, e as (select doc_id::varchar as a, 'SRC-' || s as b, 0 as turn, 'publicó' as label from shown where s in (select s from top) union all select 'SRC-' || s, 'DIS-' || d, 1, 'habla de' from tags where s in (select s from top) union all select doc_id::varchar, 'DIS-' || x, 2, 'menciona' from (select doc_id, unnest(ds) as x from shown)
 union all select 'DIS-' || x, id, 3, 'entra en' from (select id, unnest(ds) as x from told) union all select 'SRC-' || s, id, 4, 'alimenta' from told where len(ds) = 0 and s in (select s from top))
select least(a, b) as a, greatest(a, b) as b, arg_min(label, turn) as label from e group by 1, 2""")
def network_edges(spark, d):
    return _network(spark, d)[1]
