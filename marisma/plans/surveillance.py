"""Queries of narratives over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.operators import surveillance
from marisma.plans.articles import _sql_list
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A narrative is a word that texts hold; several fit a text.
NARRATIVES = ("the", "les", "und", "con", "ich", "tion", "zzz")


def _matched(spark, d):
    rows = table(spark, d, "documents")
    low = F.lower(F.coalesce("text", F.lit("")))
    named = F.filter(F.array(*[F.lit(n) for n in NARRATIVES]), lambda n: F.contains(low, F.concat(n, F.lit(" "))))
    return rows.select(
        F.explode(named).alias("narrative"), "doc_id", F.when(F.col("n_chars") % 17 != 0, F.expr("date_add(date'2026-01-01', cast(n_chars % 45 as int))")).alias("day"),
        F.when(F.col("n_chars") % 6 != 0, F.upper("lang")).alias("country"), F.when(F.col("n_chars") % 13 != 0, F.col("source")).alias("source"), F.when(F.col("n_chars") % 5 != 0, F.concat(F.lit("Fuente "), "source")).alias("name"),
    )


_MATCHED = f"""(select *, coalesce(country, 'XX') as c, coalesce(source, name, 'desconocida') as s, coalesce(name, source, 'desconocida') as sn from (select unnest(list_filter({_sql_list(NARRATIVES)}, lambda n: contains(lower(coalesce(text, '')), n || ' '))) as narrative, doc_id,
 case when n_chars % 17 <> 0 then date '2026-01-01' + (n_chars % 45)::int end as day, case when n_chars % 6 <> 0 then upper(lang) end as country, case when n_chars % 13 <> 0 then source end as source, case when n_chars % 5 <> 0 then 'Fuente ' || source end as name from documents))"""

_ROWS = f"""m as (select * from {_MATCHED}),
days as (select narrative, day, count(*) as n from m where day is not null group by 1, 2),
di as (select *, row_number() over w - 1 as i, count(*) over (partition by narrative) as c, lag(n) over w as b from days window w as (partition by narrative order by day)),
gr as (select narrative, max(c) as c, sum(n) filter (where i < c // 2) as p, sum(n) filter (where i >= c // 2) as q from di group by narrative),
en as (select narrative, arg_max(i, (n, -i)) as peak, max(n) as top, max(i) as last, arg_min(n, i) as sn, arg_max(n, i) as tn, arg_max(day, (n, -i)) as peak_day from di group by narrative),
ag as (select narrative, bool_or(i >= peak + 2 and n > b) as again from di join en using (narrative) group by narrative),
st as (select narrative, peak_day, case when peak < last and tn < top and again then 'recurrencia' when peak < last and tn < top then 'descenso' when peak = last and tn > sn then 'crecimiento' when peak = last then 'pico' when last >= 3 then 'propagacion' else 'aparicion' end as stage from en join ag using (narrative)),
cd as (select narrative, c, day, count(*) as n, min(doc_id) as k from m where day is not null group by 1, 2, 3),
cp as (select narrative, c, arg_max(day, (n, -k)) as peak from cd group by 1, 2),
cc as (select narrative, c, count(*) as n, min(doc_id) as k, min(day) as since, count(distinct s) as sources from m group by 1, 2),
ss as (select narrative, s, count(*) as n, min(doc_id) as k, arg_min(sn, doc_id) as name, arg_min(c, doc_id) as country, min(day) as since, max(day) as until, row_number() over (partition by narrative order by count(*) desc, min(doc_id)) as turn from m group by 1, 2),
who as (select narrative, count(*) as volume, min(day) as first_seen, max(day) as last_seen, count(distinct s) as sources_n, count(distinct c) filter (where c <> 'XX') as country_n, array_to_string(list(doc_id order by doc_id)[1:12], ',') as articles from m group by narrative)"""


@query(f"""with {_ROWS}
select narrative, volume::bigint as volume, first_seen, last_seen, case when gr.c >= 4 then round((q - greatest(p, 1)) * 100.0::double / greatest(p, 1), 1) else 100.0 end as growth, coalesce(stage, 'origen') as stage, peak_day, country_n::bigint as country_n, sources_n::bigint as sources_n,
 (select string_agg(day || ':' || n, ',' order by day) from days where days.narrative = who.narrative) as series,
 (select string_agg(concat_ws(':', c, n, coalesce(since::varchar, '-'), sources, coalesce(peak::varchar, '-')), ',' order by n desc, k) from cc left join cp using (narrative, c) where cc.narrative = who.narrative) as countries,
 (select string_agg(concat_ws(':', s, name, country, n, coalesce(since::varchar, '-'), coalesce(until::varchar, '-')), ',' order by turn) from ss where turn <= 12 and ss.narrative = who.narrative) as sources, articles
from who left join gr using (narrative) left join st using (narrative)""")
def narrative_overview(spark, d):
    """Narratives in whole texts, each with its countries, sources, days and stage."""
    out = surveillance.characterize(_matched(spark, d), "narrative", "doc_id", "day", "country", "source", "name")
    cell = lambda r, *names: F.concat_ws(":", *[F.coalesce(r[n].cast("string"), F.lit("-")) for n in names])
    told = lambda x, *names: F.array_join(F.transform(x, lambda r: cell(r, *names)), ",")
    return out.withColumns({
        "series": told("series", "day", "n"), "countries": told("countries", "country", "n", "first_seen", "sources", "peak_day"), "sources": told("sources", "source", "name", "country", "n", "first_seen", "last_seen"),
        "articles": F.array_join(F.transform("articles", lambda x: x.cast("string")), ","),
    })


@query(f"""with {_ROWS}
select count(*)::bigint as narratives, (count(*) filter (where stage in ('crecimiento', 'pico', 'aparicion', 'propagacion')))::bigint as active,
 (count(*) filter (where case when gr.c >= 4 then round((q - greatest(p, 1)) * 100.0::double / greatest(p, 1), 1) else 100.0 end >= 40))::bigint as growing, (select count(distinct c) from m where c <> 'XX')::bigint as countries
from who left join gr using (narrative) left join st using (narrative)""")
def narrative_kpis(spark, d):
    return surveillance.kpis(surveillance.characterize(_matched(spark, d), "narrative", "doc_id", "day", "country", "source", "name"))
