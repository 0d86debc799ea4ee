"""Queries of writes and small rules: membership, caches, reviews, caps, dates, names, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.functions import facts, upkeep
from marisma.operators import cards, graph, relations, relevance
from marisma.plans.articles import _HOST, _IDS, _RELEVANCE, ARTICLES, _any, _named, _sql_list, articles, judged
from marisma.sinks import tables
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add




@query("""with old as (select n_chars % 40 as owner, doc_id as member from documents), new as (select n_chars % 40 as owner, doc_id + 1 as member from documents where n_chars % 40 < 10 and n_chars % 3 = 0)
select distinct * from (select * from old where owner not in (select owner from new) union all select * from new)""")
def membership_replace(spark, d):
    rows = table(spark, d, "documents")
    old = rows.select((F.col("n_chars") % 40).alias("owner"), F.col("doc_id").alias("member"))
    new = rows.where("n_chars % 40 < 10 and n_chars % 3 = 0").select((F.col("n_chars") % 40).alias("owner"), (F.col("doc_id") + 1).alias("member"))
    return tables.replace_members(old, new.unionByName(new), "owner")


@query("""with r as (select sha256(text) as text_hash, substr(text, 1, 8000) as source_text, 'T' || doc_id as translated, 'p' as provider, doc_id as created_at from documents union all select sha256('a'), 'a', 'A', 'q', -1)
select text_hash, sha256(source_text) as source_sha256, translated, provider, created_at from (select *, row_number() over (partition by text_hash order by created_at desc) as turn from r) where turn = 1""")
def translation_upsert(spark, d):
    cache = spark.createDataFrame([("a", "A", "q", -1)], "source_text string, translated string, provider string, created_at bigint").withColumn("text_hash", F.sha2("source_text", 256)).select("text_hash", "source_text", "translated", "provider", "created_at")
    new = table(spark, d, "documents").select(F.col("text").alias("source_text"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("translated"), F.lit("p").alias("provider"), F.col("doc_id").alias("created_at"))
    out = tables.put_translations(cache, new)
    return out.select("text_hash", F.sha2("source_text", 256).alias("source_sha256"), "translated", "provider", "created_at")


_LABEL = "case floor(value)::bigint % 5 when 0 then ' Validado ' when 1 then 'descartado' when 2 then 'MODIFICADO' when 3 then 'otro' end"


@query(f"""with r as (select user_id, event_id, lower(trim(coalesce({_LABEL}, ''))) as l, event_type as why from events where event_type <> 'view'),
a as (select user_id, 'Insuficiente' as verdict, count(*)::bigint as risk from events group by user_id),
g as (select user_id, max_by(l, event_id) as last, max_by(l, event_id) filter (where l in ('validado', 'descartado', 'modificado')) as v, max_by(why, event_id) filter (where l in ('validado', 'descartado', 'modificado')) as why,
  max_by(l, event_id) filter (where l in ('validado', 'descartado')) as r, count(*) as decisions, count(*) filter (where l <> 'modificado') as closed from r group by user_id)
select user_id, case v when 'validado' then 'RESPALDADO' when 'descartado' then 'CONTRADICHO' when 'modificado' then 'REVISIÓN HUMANA' else verdict end as verdict,
  case r when 'validado' then 22 when 'descartado' then 82 else risk end as risk, case when last = 'modificado' then 'pending_review' when last is not null then 'reviewed' end as status, 'hitl_' || v as rule, v as hitl_label, why as hitl_reason,
  coalesce(decisions, 0)::bigint as decisions, coalesce(closed, 0)::bigint as closed from a left join g using (user_id)""")
def review_states(spark, d):
    e = table(spark, d, "events")
    n = F.floor("value") % 5
    label = F.when(n == 0, " Validado ").when(n == 1, "descartado").when(n == 2, "MODIFICADO").when(n == 3, "otro")
    articles = e.groupBy("user_id").agg(F.lit("Insuficiente").alias("verdict"), F.count(F.lit(1)).alias("risk"))
    return cards.review_states(articles, e.where("event_type <> 'view'").withColumn("label", label), "user_id", "event_id", "label", "event_type")


@query("""with g as (select user_id, event_id, event_type = 'purchase' as ok, sum((event_type = 'purchase')::int) over (partition by user_id order by event_id) as good from events)
select user_id, event_id, (sum((not ok)::int) over (partition by user_id, good order by event_id))::bigint as failures from g""")
def running_failures(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("ok"))
    return cards.running_failures(e, "user_id", "event_id", "ok").select("user_id", "event_id", "failures")


_KEYS3 = "select doc_id, 'u' || n_chars // 3 as url_hash, 'c' || left(sha256(text), 3) as content_id, case when n_chars % 7 = 0 then null else 't' || left(sha256(left(text, 8)), 3) end as text_hash from documents"


@query(f"""with recursive s as ({_KEYS3}), o as (select * from s where doc_id % 10 = 0),
n as (select *, row_number() over (order by doc_id) as i from s where doc_id % 10 <> 0 and url_hash not in (select url_hash from o) and content_id not in (select content_id from o) and (text_hash is null or text_hash not in (select text_hash from o where text_hash is not null))),
w(i, kept, us, cs, ts) as (select 0::bigint, false, []::varchar[], []::varchar[], []::varchar[] union all
 select n.i, not (list_contains(w.us, n.url_hash) or list_contains(w.cs, n.content_id) or coalesce(list_contains(w.ts, n.text_hash), false)),
  case when list_contains(w.us, n.url_hash) or list_contains(w.cs, n.content_id) or coalesce(list_contains(w.ts, n.text_hash), false) then w.us else list_append(w.us, n.url_hash) end,
  case when list_contains(w.us, n.url_hash) or list_contains(w.cs, n.content_id) or coalesce(list_contains(w.ts, n.text_hash), false) then w.cs else list_append(w.cs, n.content_id) end,
  case when n.text_hash is null or list_contains(w.us, n.url_hash) or list_contains(w.cs, n.content_id) or coalesce(list_contains(w.ts, n.text_hash), false) then w.ts else list_append(w.ts, n.text_hash) end from w join n on n.i = w.i + 1)
select doc_id from o union all select n.doc_id from w join n using (i) where w.kept""")
def insert_three_keys(spark, d):
    s = table(spark, d, "documents").selectExpr("doc_id", "concat('u', n_chars div 3) as url_hash", "concat('c', left(sha2(text, 256), 3)) as content_id", "case when n_chars % 7 <> 0 then concat('t', left(sha2(left(text, 8), 256), 3)) end as text_hash")
    return tables.insert_unique(s.where("doc_id % 10 = 0"), s.where("doc_id % 10 <> 0"), [["url_hash"], ["content_id"], ["text_hash"]], "doc_id").select("doc_id")


@query("select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) > 7 as removed from orders where o_custkey % 5 = 0")
def copies_rotation(spark, d):
    c = table(spark, d, "orders").where("o_custkey % 5 = 0").select("o_orderkey", "o_orderdate")
    return tables.kept_copies(c, "o_orderdate", 7).select("o_orderkey", "removed")


@query("""with old as (select doc_id % 60 as owner, case when doc_id % 2 = 0 then 'ANIMAL' else 'PERSON' end as kind, lang as value from documents), new as (select doc_id % 60 as owner, case when doc_id % 3 = 0 then 'PERSON' else 'ANIMAL' end as kind, upper(source) as value from documents where doc_id % 60 < 30
 union all select doc_id % 60, 'PERSON', upper(lang) from documents where doc_id % 60 < 30), o as (select distinct owner from new),
b as (select *, 0 as turn from old where owner not in (select owner from o) or kind <> 'ANIMAL' union all select *, 1 from new)
select owner, kind, (min({turn: turn, value: value})).value as value from b group by owner, kind, lower(value)""")
def entities_replace(spark, d):
    r = table(spark, d, "documents")
    old = r.select((F.col("doc_id") % 60).alias("owner"), F.when(F.col("doc_id") % 2 == 0, "ANIMAL").otherwise("PERSON").alias("kind"), F.col("lang").alias("value"))
    some = r.where("doc_id % 60 < 30")
    new = some.select((F.col("doc_id") % 60).alias("owner"), F.when(F.col("doc_id") % 3 == 0, "PERSON").otherwise("ANIMAL").alias("kind"), F.upper("source").alias("value"))
    new = new.unionByName(some.select((F.col("doc_id") % 60).alias("owner"), F.lit("PERSON").alias("kind"), F.upper("lang").alias("value")))
    return tables.replace_entities(old, new, "owner", ["ANIMAL"])


_CARDS = f"(select doc_id % 25 as owner, doc_id, url, length(snippet) >= 85 as usable, {_HOST} as host from {ARTICLES})"


@query(f"select owner, doc_id, host, turn::int as turn from (select *, row_number() over (partition by owner order by doc_id) as turn from (select *, row_number() over (partition by owner, host order by doc_id) as r from {_CARDS} where host <> '') where r = 1) where turn <= 4")
def evidence_cards(spark, d):
    a = articles(spark, d).select((F.col("doc_id") % 25).alias("owner"), "doc_id", "url")
    return cards.capped(a, "owner", "doc_id", "url").select("owner", "doc_id", "host", "turn")


@query(f"select owner, doc_id, host, turn::int as turn from (select *, row_number() over (partition by owner order by doc_id) as turn from (select *, row_number() over (partition by owner, host order by doc_id) as r from {_CARDS} where host <> '' and usable) where r = 1) where turn <= 4")
def usable_cards(spark, d):
    a = articles(spark, d).select((F.col("doc_id") % 25).alias("owner"), "doc_id", "url", "snippet")
    return cards.capped(a, "owner", "doc_id", "url", usable=F.length("snippet") >= 85).select("owner", "doc_id", "host", "turn")


@query(f"select doc_id, array_to_string(list_sort(list_distinct(list_filter([{', '.join(f'''case when contains(lower(url), '{n}') then '{i}' end''' for n, i in upkeep.URL_DISEASES.items())}], lambda v: v is not null))), '|') as diseases from {ARTICLES}")
def url_disease(spark, d):
    return articles(spark, d).select("doc_id", F.array_join(upkeep.url_diseases(F.col("url")), "|").alias("diseases"))


_PUBLISHED = "(select doc_id, case doc_id % 5 when 0 then strftime(day, '%Y%m%d') || 'T101500' when 1 then strftime(day, '%Y-%m-%d') || 'T23:30:00-03:00' when 2 then 'Mon, ' || strftime(day, '%-d %b %Y') || ' 08:00:00 GMT' when 3 then '' else 'ayer' end as p, strftime(day + 2, '%Y-%m-%d') as c, day from " + ARTICLES + ")"


@query(f"""select doc_id, strftime(case doc_id % 5 when 0 then day when 1 then day + 1 when 2 then day else day + 2 end, '%Y-%m-%d') as news_day, case doc_id % 5 when 1 then strftime(day, '%Y-%m-%d') when 2 then strftime(day, '%Y-%m-%d') else '' end as plain_day, substr(p, 1, 10) as raw_day,
 strftime(case doc_id % 5 when 1 then day + 1 else day + 2 end, '%Y-%m-%d') as iso_day from {_PUBLISHED}""")
def day_variants(spark, d):
    """Four rules for a day, over five layouts of a date."""
    a = articles(spark, d)
    p = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.date_format("day", "yyyyMMdd"), F.lit("T101500"))).when(F.col("doc_id") % 5 == 1, F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T23:30:00-03:00")))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("Mon, "), F.date_format("day", "d MMM yyyy"), F.lit(" 08:00:00 GMT"))).when(F.col("doc_id") % 5 == 3, "").otherwise("ayer")
    )
    a = a.select("doc_id", p.alias("p"), F.date_format(F.date_add("day", 2), "yyyy-MM-dd").alias("c"))
    return a.select("doc_id", upkeep.day_of_news(F.col("p"), F.col("c")).alias("news_day"), upkeep.day_plain(F.col("p")).alias("plain_day"), upkeep.day_raw(F.col("p")).alias("raw_day"), F.date_format(upkeep.first_iso(F.col("p"), F.col("c")), "yyyy-MM-dd").alias("iso_day"))


@query("select event_id, greatest(0, floor(epoch(ts - timestamp '2024-01-15 12:00:00') / 60))::bigint as minutes from events")
def minutes_until(spark, d):
    return table(spark, d, "events").select("event_id", upkeep.minutes_until(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).alias("minutes"))


_HEALTH = ("animal", "ganado", "aves", "granja", "gripe", "peste", "brote", "vacuna")


@query(f"select doc_id, round(least(1.0, ({' + '.join(f'''contains(lower(text), '{t}')::int''' for t in _HEALTH)}) / 4.0)::double, 3) as score from {ARTICLES}")
def health_share(spark, d):
    return articles(spark, d).select("doc_id", upkeep.share_of_four(F.col("text"), _HEALTH).alias("score"))


_CLASSES = ("OFFICIAL_DOCUMENT", "SOCIAL_MEDIA", "PHOTOGRAPH", "MEME", "OTHER")
_PICTURE = f"""case when {_any('h', upkeep.OFFICIAL_PICTURES)} then 'OFFICIAL_DOCUMENT' when {_any('h', upkeep.SOCIAL_PICTURES)} then 'SOCIAL_MEDIA' when {_any('h', ('youtube.com', 'youtu.be', 'ytimg.com'))} then 'PHOTOGRAPH' when {_any('lower(url)', ('meme', 'funny'))} then 'MEME' end"""


@query(f"""select doc_id, label, confidence, array_to_string([c || '=' || printf('%.4f', case when c = label then round(confidence, 4) else round(greatest(0.02, (1 - confidence) / 4), 4) end) for c in {_sql_list(_CLASSES)}], ' ') as scores from (
 select doc_id, label, case label when 'OFFICIAL_DOCUMENT' then 0.78::double when 'SOCIAL_MEDIA' then 0.76::double when 'PHOTOGRAPH' then 0.7::double else 0.65::double end as confidence from (select doc_id, {_PICTURE} as label from (select *, {_HOST} as h from {ARTICLES}))) where label is not null""")
def picture_scores(spark, d):
    rows = articles(spark, d).select("doc_id", upkeep.picture_class(F.col("url")).alias("p")).where("p is not null").select("doc_id", "p.label", "p.confidence")
    scores = upkeep.filled_scores(F.col("label"), F.col("confidence"), _CLASSES)
    return rows.select("doc_id", "label", "confidence", F.concat_ws(" ", *[F.format_string("%s=%.4f", F.lit(c), scores[c]) for c in _CLASSES]).alias("scores"))


_NAMES = {"woah.org": "WOAH", "gob.mx": "Gobierno de México", "youtu.be": "YouTube"}


@query(f"""select doc_id, case {' '.join(f"when h = '{k}' or ends_with(h, '.{k}') then '{v}'" for k, v in _NAMES.items())} when doc_id % 4 <> 0 then source_id when upper(kind) not like 'SRC-%' then kind else h end as name from (select *, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) as h from {ARTICLES})""")
def source_names(spark, d):
    name = F.when(F.col("doc_id") % 4 != 0, F.col("source_id")).otherwise("SRC-9")
    return articles(spark, d).select("doc_id", upkeep.source_name(F.col("url"), _NAMES, name, F.col("kind")).alias("name"))


@query(f"select doc_id, {_any('lower(t)', upkeep.BIOGRAPHY)} as biography from (select doc_id, case when doc_id % 6 = 0 then 'She joined the United Nations in 1999. ' else '' end || snippet as t from {ARTICLES})")
def biography_filter(spark, d):
    a = articles(spark, d).select("doc_id", F.concat(F.when(F.col("doc_id") % 6 == 0, "She joined the United Nations in 1999. ").otherwise(""), "snippet").alias("t"))
    return a.select("doc_id", upkeep.is_biography(F.col("t")).alias("biography"))


@query("""select event_id, case when event_type = 'click' then 'stored' else 'computed' end || ':' || user_id as nli, 'computed:' || event_id as parts from events""")
def why_merged(spark, d):
    e = table(spark, d, "events")
    stored = F.when(F.col("event_type") == "click", F.create_map(F.lit("nli"), F.concat(F.lit("stored:"), F.col("user_id").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    computed = F.create_map(F.lit("nli"), F.concat(F.lit("computed:"), F.col("user_id").cast("string")), F.lit("parts"), F.concat(F.lit("computed:"), F.col("event_id").cast("string")))
    m = upkeep.merged(stored, computed)
    return e.select("event_id", m["nli"].alias("nli"), m["parts"].alias("parts"))


@query("""select doc_id, sha256(case when lang = 'es' or trim(text) = '' then text when doc_id % 10 = 0 then 'cached ' || doc_id else substr(text, 1, 2500) end) as shown_sha256 from documents""")
def shown_translation(spark, d):
    r = table(spark, d, "documents")
    cached = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("cached "), F.col("doc_id").cast("string")))
    shown = F.when(F.col("lang") == "es", F.col("text")).otherwise(upkeep.shown_text(F.col("text"), cached, False))
    return r.select("doc_id", F.sha2(shown, 256).alias("shown_sha256"))


@query("""with e as (select l_orderkey % 200 as a, l_partkey % 200 as b, l_returnflag as c from lineitem), k as (select least(a, b) as a, greatest(a, b) as b, count(*)::bigint as value from e where a <> b and c = 'R' group by 1, 2) select * from k where value >= 2""")
def category_subgraph(spark, d):
    """The part of a graph whose links are of one category, without thin edges."""
    e = table(spark, d, "lineitem").selectExpr("l_orderkey % 200 as a", "l_partkey % 200 as b", "l_returnflag as c", "l_linenumber as seq").where("c = 'R'")
    return graph.edges(e, "a", "b", "c", "seq").where("value >= 2").select("a", "b", "value")


@query(f"""select doc_id, 'DISEASE' as kind, unnest({_named('l', _IDS)}) as canonical from (select doc_id, lower(title || ' ' || snippet) as l from {ARTICLES}) union all select doc_id, 'ANIMAL', unnest({_named('l', facts.ANIMALS)}) from (select doc_id, lower(title || ' ' || snippet) as l from {ARTICLES})
 union all select doc_id, 'LOCATION', unnest({_named('l', facts.PLACES)}) from (select doc_id, lower(title || ' ' || snippet) as l from {ARTICLES})""")
def entity_gazetteer(spark, d):
    """Names of diseases, animals and places, each canonical name once for each article."""
    low = F.lower(F.concat_ws(" ", "title", "snippet"))
    rows, found = articles(spark, d), []
    for kind, named in (("DISEASE", _IDS), ("ANIMAL", facts.ANIMALS), ("LOCATION", facts.PLACES)):
        part = rows.select("doc_id", F.lit(kind).alias("kind"), F.explode_outer(facts.canonical(low, named)).alias("canonical")).where("canonical is not null")
        found.append(part)
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"select doc_id, skip as skipped from {_RELEVANCE}")
def relevance_gate(spark, d):
    return judged(articles(spark, d)).select("doc_id", F.col("skip").alias("skipped"))


@query("select a.vec_id as query, b.vec_id as match, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as cosine from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 and round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) >= 0.35")
def semantic_near(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return relations.cosine_pairs(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", least=0.35)
