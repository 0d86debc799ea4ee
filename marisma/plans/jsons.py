"""Queries of JSON in text columns, well formed and not."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.functions import jsons
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FULL = """'{"k": ' || json_extract_string(props, '$.k') || ', "nested": {"a": [1, {"b": ' || user_id || '}]}, "none": null, "say": "a } b"}'"""
_REPLY = f"""case event_id % 8 when 0 then props when 1 then 'Here it is ```json' || chr(10) || {_FULL} || chr(10) || '``` done' when 2 then 'Sure: ' || {_FULL} || ' ok' when 3 then left({_FULL}, length({_FULL}) - 1)
 when 4 then '[1, ' || props || ']' when 5 then '```' || left(props, 3) || '```' when 6 then '  ' || {_FULL} || chr(10) else null end"""


def _replies(spark, d):
    e = table(spark, d, "events")
    full = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "nested": {"a": [1, {"b": '), F.col("user_id").cast("string"), F.lit('}]}, "none": null, "say": "a } b"}'))
    n = F.col("event_id") % 8
    cut = F.expr("substring(full, 1, length(full) - 1)")
    e = e.withColumn("full", full)
    reply = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("Here it is ```json\n"), "full", F.lit("\n``` done"))).when(n == 2, F.concat(F.lit("Sure: "), "full", F.lit(" ok"))).when(n == 3, cut)
    reply = reply.when(n == 4, F.concat(F.lit("[1, "), "props", F.lit("]"))).when(n == 5, F.concat(F.lit("```"), F.substring("props", 1, 3), F.lit("```"))).when(n == 6, F.concat(F.lit("  "), "full", F.lit("\n")))
    return e.withColumn("reply", reply)


@query(f"""with r as (select event_id, trim(coalesce({_REPLY}, ''), ' ' || chr(10)) as t from events), f as (select event_id, case when contains(t, '```') then trim(regexp_extract(t, '```(?:json)?\\s*([\\s\\S]*?)```', 1), ' ' || chr(10)) else t end as t from r),
v as (select event_id, case when json_valid(t) then t else regexp_extract(t, '\\{{[\\s\\S]*\\}}', 0) end as t from f), o as (select event_id, case when json_valid(t) then case when json_type(t) = 'OBJECT' then t::json end end as j from v)
select event_id, j is not null as found, json_extract_string(j, '$.k')::bigint as k, json_extract_string(j, '$.nested.a[1].b')::bigint as b, json_extract_string(j, '$.say') as say, json_extract_string(j, '$.absent') as absent from o""")
def json_salvaged(spark, d):
    """Objects in replies that are fenced, framed by words, cut off, no objects or absent."""
    rows = _replies(spark, d).select("event_id", jsons.salvaged(F.col("reply")).alias("v"))
    return rows.select("event_id", F.col("v").isNotNull().alias("found"), jsons.field(F.col("v"), "$.k", "bigint").alias("k"), jsons.field(F.col("v"), "$.nested.a[1].b", "bigint").alias("b"), jsons.field(F.col("v"), "$.say").alias("say"), jsons.field(F.col("v"), "$.absent").alias("absent"))


_EXTRA = """case event_id % 5 when 0 then '{"k": null, "model": "m' || user_id || '"}' when 1 then '{"why": {"rule": "r", "score": [1, 2]}}' when 2 then '{"k": "x"' when 3 then '{"why": 1, "zz": true}' end"""
_FIELDS = "select event_id, k, case when json_type(j, '$.' || k) = 'NULL' then 'null' else json_extract(j, '$.' || k)::varchar end as v"


@query(f"""with e as (select event_id, props, {_EXTRA} as x from events), a as (select event_id, props::json as j from e), b as (select event_id, x::json as j from e where json_valid(x)),
ka as (select event_id, j, unnest(json_keys(j)) as k from a), kb as (select event_id, j, unnest(json_keys(j)) as k from b), fb as ({_FIELDS} from kb), fa as ({_FIELDS} from ka where (event_id, k) not in (select event_id, k from kb))
select event_id, string_agg(k || '=' || v, ';' order by k) as fields from (select * from fa union all select * from fb) group by event_id""")
def json_merged(spark, d):
    """The fields of two objects, the second one's last; a text that is cut off or absent adds none."""
    n = F.col("event_id") % 5
    extra = F.when(n == 0, F.concat(F.lit('{"k": null, "model": "m'), F.col("user_id").cast("string"), F.lit('"}'))).when(n == 1, '{"why": {"rule": "r", "score": [1, 2]}}').when(n == 2, '{"k": "x"').when(n == 3, '{"why": 1, "zz": true}')
    rows = table(spark, d, "events").select("event_id", F.array_sort(F.map_entries(F.transform_values(jsons.merged(F.col("props"), extra), lambda _, v: F.to_json(v)))).alias("m"))
    return rows.select("event_id", F.array_join(F.transform("m", lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("fields"))


CLASSES = ("PHOTOGRAPH", "MAP", "CHART", "SCREENSHOT", "DRAWING", "DOCUMENT", "OTHER")
_LABEL = f"([{', '.join(repr(c) for c in CLASSES)}])[event_id % 7 + 1]"
_CONF = "json_extract_string(props, '$.k')::double / 100"
_SCORES = """case event_id % 4 when 0 then '{"MAP": ' || (user_id % 10) / 10.0 || ', "CHART": ' || (event_id % 10) / 10.0 || '}' when 1 then '{"MAP": 0.9' when 2 then '{}' end"""


@query(f"""with e as (select event_id, {_LABEL} as label, {_CONF} as c, case when json_valid({_SCORES}) and {_SCORES} <> '{{}}' then [struct_pack(label := 'MAP', v := ((user_id % 10) / 10.0)::double), struct_pack(label := 'CHART', v := ((event_id % 10) / 10.0)::double)] end as s from events),
f as (select event_id, coalesce(s, list_transform([{', '.join(repr(c) for c in CLASSES)}], lambda n: struct_pack(label := n, v := case when n = label then round(greatest(c, 0.42), 4) else round(greatest(0.05, 1.0 - greatest(c, 0.4)) / 6, 4) end))) as s from e)
select event_id, len(s)::int as classes, (select x.label from (select unnest(s) as x) order by x.v desc, x.label limit 1) as label, (select max(x.v) from (select unnest(s) as x)) as score from f""")
def score_argmax(spark, d):
    """The best class of maps of scores; a map that is absent, empty or cut off is filled from label and confidence."""
    e = table(spark, d, "events")
    label = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("event_id") % 7 + 1).cast("int"))
    n = F.col("event_id") % 4
    tenth = lambda c: ((F.col(c) % 10) / 10).cast("string")
    text = F.when(n == 0, F.concat(F.lit('{"MAP": '), tenth("user_id"), F.lit(', "CHART": '), tenth("event_id"), F.lit("}"))).when(n == 1, '{"MAP": 0.9').when(n == 2, "{}")
    rows = e.select("event_id", jsons.filled_scores(text, label, F.get_json_object("props", "$.k").cast("double") / 100, CLASSES).alias("s"))
    best = jsons.best(F.col("s"))
    return rows.select("event_id", F.size("s").alias("classes"), best["label"].alias("label"), best["score"].alias("score"))


@query("""with e as (select user_id, event_id, case when event_id % 3 = 0 then '' when event_id % 3 = 1 then event_type end as own, case event_id % 4 when 0 then '{"state": "' || event_type || '!"}' when 1 then '{"state": ""}' when 2 then '{"state"' end as extra from events)
select user_id, count(*)::bigint as n, count(coalesce(nullif(own, ''), nullif(case when json_valid(extra) then json_extract_string(extra, '$.state') end, '')))::bigint as known,
 max(coalesce(nullif(own, ''), nullif(case when json_valid(extra) then json_extract_string(extra, '$.state') end, ''))) as last_state from e group by user_id""")
def extra_promoted(spark, d):
    """Columns that are empty take the field of their name from a JSON column."""
    e = table(spark, d, "events")
    own = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("event_type"))
    n = F.col("event_id") % 4
    extra = F.when(n == 0, F.concat(F.lit('{"state": "'), "event_type", F.lit('!"}'))).when(n == 1, '{"state": ""}').when(n == 2, '{"state"')
    rows = e.select("user_id", jsons.promoted(own, extra, "state").alias("state"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("state").alias("known"), F.max("state").alias("last_state"))
