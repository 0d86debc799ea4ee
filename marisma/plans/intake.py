"""Queries of what comes in: imports with caps, visits, purges, orders of listings, merges of two stores, pictures to show."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marisma.functions import pictures, text
from marisma.operators import intake
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TITLE = "trim(split_part(coalesce(text, ''), chr(10), 1))"
_URL = "case doc_id % 7 when 0 then 'https://openalex.org/W' || doc_id when 1 then 'https://x.example.com/' || doc_id when 2 then 'ftp://site.net/' || doc_id else 'http://site' || doc_id % 11 || '.net/' || doc_id end"
_FAKE = f"(regexp_matches(lower(url), 'example\\.invalid|example\\.com|social\\.local|rumor-vacuna|rumor vacuna'))"


@query(f"""with r as (select doc_id, {_URL} as url, {_TITLE} as title, case when doc_id % 5 = 0 then '' else text end as body, case when doc_id % 9 = 0 then 'gone' else 'active' end as status, case when doc_id % 17 <> 0 then n_chars end as fetched from documents),
v as (select doc_id, case when contains(url, 'openalex.org') then 'paper' else 'news' end as class, url, title, trim(coalesce(nullif(body, ''), title)) as b, fetched from r where status = 'active' and starts_with(url, 'http') and not {_FAKE} and length(title) >= 8)
select doc_id, class, url, sha256(title) as title_sha256, sha256(coalesce(nullif(substr(b, 1, 2500), ''), title)) as text_sha256, turn::int as turn from (select *, row_number() over (partition by class order by fetched desc nulls last, doc_id) as turn from v) where turn <= case class when 'paper' then 25 else 90 end""")
def import_capped(spark, d):
    """Documents of an import: caps of articles and papers count what is valid."""
    n = F.col("doc_id")
    number = n.cast("string")
    m = n % 7
    url = F.when(m == 0, F.concat(F.lit("https://openalex.org/W"), number)).when(m == 1, F.concat(F.lit("https://x.example.com/"), number)).when(m == 2, F.concat(F.lit("ftp://site.net/"), number)).otherwise(F.concat(F.lit("http://site"), (n % 11).cast("string"), F.lit(".net/"), number))
    rows = table(spark, d, "documents").select("doc_id", url.alias("url"), F.trim(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).alias("title"), F.when(n % 5 == 0, "").otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("snippet"), F.when(n % 9 == 0, "gone").otherwise("active").alias("status"), F.when(n % 17 != 0, F.col("n_chars")).alias("fetched"))
    return intake.imported(rows, "doc_id").select("doc_id", "class", "url", F.sha2("title", 256).alias("title_sha256"), F.sha2("text", 256).alias("text_sha256"), "turn")


@query("""with r as (select conv_id * 100 + turn as id, case when turn % 3 = 0 then '  ' else text end as content, case when turn % 2 = 0 then 'https://www.youtube.com/watch?v=' || conv_id else 'http://nowhere.test/' end as url, length(text) as created from conversations)
select id, url, sha256(title) as title_sha256, turn::int as turn from (select id, case when contains(url, 'youtube') then url else 'inapp:social/' || id end as url, substr(trim(content), 1, 140) as title, row_number() over (order by created desc nulls last, id) as turn from r where trim(coalesce(content, '')) <> '') where turn <= 40""")
def import_posts(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")).alias("content"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("conv_id").cast("string"))).otherwise("http://nowhere.test/").alias("url"), F.length("text").alias("created"))
    return intake.imported_posts(rows, "id").select("id", "url", F.sha2("title", 256).alias("title_sha256"), "turn")


_SOURCES = """(select user_id, ['API', 'web', 'rss', 'scrape', ''][user_id % 5 + 1] as declared, case when user_id % 11 = 0 then 'http://api/' || user_id end as api_url, case when user_id % 3 = 0 then 'http://feed/' || user_id else '' end as rss_url, case when user_id % 7 = 0 then 'aggregator' else 'media' end as type,
 case when user_id % 4 = 0 then 45 when user_id % 4 = 1 then 0 end as freq, ['critical', 'high', 'normal', 'low', 'scientific', 'odd'][user_id % 6 + 1] as priority, case when user_id % 8 = 0 then max(ts) end as next_check, case when user_id % 9 <> 0 then min(ts) + interval 5 day end as last_checked, user_id % 10 <> 0 as active, user_id % 9 as confidence from events group by user_id)"""
_WAY = "case when lower(declared) = 'api' or coalesce(api_url, '') <> '' or (type = 'aggregator' and rss_url = '') then 'api' when rss_url <> '' then 'rss' when lower(declared) in ('rss', 'scrape') then lower(declared) else 'scrape' end"
_MINUTES = "coalesce(nullif(freq, 0), case priority when 'critical' then 15 when 'high' then 30 when 'low' then 360 when 'scientific' then 720 else 60 end)"


def _sources(spark, d):
    u = F.col("user_id")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    s = table(spark, d, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("until"), F.min(F.col("ts").cast("timestamp")).alias("since"))
    number = u.cast("string")
    return s.select(
        "user_id", pick(("API", "web", "rss", "scrape", ""), u % 5).alias("access_method"), F.when(u % 11 == 0, F.concat(F.lit("http://api/"), number)).alias("api_url"), F.when(u % 3 == 0, F.concat(F.lit("http://feed/"), number)).otherwise("").alias("rss_url"), F.when(u % 7 == 0, "aggregator").otherwise("media").alias("type"),
        F.when(u % 4 == 0, 45).when(u % 4 == 1, 0).alias("frequency_minutes"), pick(("critical", "high", "normal", "low", "scientific", "odd"), u % 6).alias("priority"), F.when(u % 8 == 0, F.col("until")).alias("next_check"), F.when(u % 9 != 0, F.col("since") + F.expr("interval 5 day")).alias("last_checked"),
        (u % 10 != 0).alias("active"), (u % 9).alias("confidence"),
    )


@query(f"""with s as (select *, {_WAY} as method, {_MINUTES} as minutes, (select max(ts) - interval 1 day from events) as now from {_SOURCES}), d as (select * from s where active and method in ('api', 'rss') and coalesce(next_check, last_checked + minutes * interval 1 minute, now) <= now)
select 'due' as asked, user_id, method, minutes, case method when 'api' then api_url else rss_url end as url, (confidence * 10)::int as confidence from d union all select 'forced', user_id, method, minutes, null, (confidence * 10)::int from s where active and method = 'scrape'""")
def visits_due(spark, d):
    """Sources to be visited by interface or feed, and all that are read page by page when they are asked for."""
    s = _sources(spark, d)
    now = table(spark, d, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("interval 1 day")).alias("now"))
    timed = s.crossJoin(F.broadcast(now))
    return intake.due(timed, "user_id", F.col("now")).withColumn("asked", F.lit("due")).union(intake.due(s, "user_id", F.lit(None), ("scrape",), force=True).withColumn("asked", F.lit("forced")))


@query("""with s as (select user_id, min(ts) as last_checked, null::varchar as last_error, 'x' as name from events group by user_id), r as (select user_id, case when user_id % 2 = 0 then max(ts) end as last_checked, case when user_id % 3 = 0 then 'HTTP' end as last_error, count(*) as failures from events where event_type = 'error' group by user_id)
select s.user_id, name, coalesce(r.last_checked, s.last_checked) as last_checked, coalesce(r.last_error, s.last_error) as last_error, r.failures::bigint as consecutive_failures,
 case when r.failures is null then null else floor(epoch(coalesce(r.last_checked, s.last_checked)))::bigint + case when r.failures <= 66 then 30 when r.failures = 67 then 120 else 21600 end end as later from s left join r using (user_id)""")
def runtime_merged(spark, d):
    """Listed sources with what was seen of them, and when they are visited again."""
    e, u = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("user_id")
    s = e.groupBy("user_id").agg(F.min("ts").alias("last_checked"), F.lit(None).cast("string").alias("last_error"), F.lit("x").alias("name"))
    seen = e.where("event_type = 'error'").groupBy("user_id").agg(F.when(u % 2 == 0, F.max("ts")).alias("last_checked"), F.when(u % 3 == 0, "HTTP").alias("last_error"), F.count(F.lit(1)).alias("consecutive_failures"))
    out = intake.with_runtime(s, seen, "user_id", ("last_checked", "last_error", "consecutive_failures"))
    later = F.unix_timestamp(intake.later(F.col("consecutive_failures") - 65, F.col("last_checked")))
    return out.select("user_id", "name", F.col("last_checked").cast("timestamp_ntz").alias("last_checked"), "last_error", "consecutive_failures", later.alias("later"))


_BAD = " or ".join(f"url ilike '{p}'" for p in intake.PURGED)
_PAGE_URL = "case page_id % 12 when 0 then 'HTTP://LOCALHOST/x' when 1 then 'https://www.WOAH.org/en/demo/1' when 2 then 'inapp:1' when 3 then 'http://a.net/rumor-vacuna' else replace(url, 'example.net', 'exemplar.net') end"


@query(f"""with a as (select page_id, {_PAGE_URL} as url from pages), g as (select page_id from a where {_BAD}), c as (select page_id * 10 + k as claim_id, page_id from pages, range(3) t(k)), e as (select c.claim_id, case when c.claim_id % 4 = 0 then 'catalog://1' when c.claim_id % 4 = 1 then 'https://x.EXAMPLE.com/' else 'https://ok.net/' || c.claim_id end as url from c)
select 'articles' as what, count(*)::bigint as n, coalesce(sum(page_id), 0)::bigint as ids from a where page_id not in (select * from g) union all select 'claims', count(*)::bigint, sum(claim_id)::bigint from c where page_id not in (select * from g)
 union all select 'evidence', count(*)::bigint, sum(claim_id)::bigint from e where claim_id // 10 not in (select * from g) union all select 'emptied', count(*)::bigint, sum(claim_id)::bigint from e where claim_id // 10 not in (select * from g) and (claim_id % 4 in (0, 1)) union all select 'images', count(*)::bigint, sum(page_id)::bigint from a where page_id % 2 = 0 and page_id not in (select * from g)""")
def purge_cascade(spark, d):
    """Articles of made-up addresses go with their claims, evidence and pictures; bad addresses of other evidence become empty."""
    n = F.col("page_id") % 12
    url = F.when(n == 0, "HTTP://LOCALHOST/x").when(n == 1, "https://www.WOAH.org/en/demo/1").when(n == 2, "inapp:1").when(n == 3, "http://a.net/rumor-vacuna").otherwise(F.replace("url", F.lit("example.net"), F.lit("exemplar.net")))
    a = table(spark, d, "pages").select("page_id", url.alias("url"))
    c = a.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select((F.col("page_id") * 10 + F.col("k")).alias("claim_id"), "page_id")
    k = F.col("claim_id") % 4
    e = c.select("claim_id", F.when(k == 0, "catalog://1").when(k == 1, "https://x.EXAMPLE.com/").otherwise(F.concat(F.lit("https://ok.net/"), F.col("claim_id").cast("string"))).alias("url"))
    kept, children, claims, evidence = intake.purged(a, "page_id", {"images": a.where("page_id % 2 = 0").select("page_id")}, c, "claim_id", e)
    row = lambda what, t, key: t.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(key), F.lit(0)).alias("ids"))
    return row("articles", kept, "page_id").union(row("claims", claims, "claim_id")).union(row("evidence", evidence, "claim_id")).union(row("emptied", evidence.where("url = ''"), "claim_id")).union(row("images", children["images"], "page_id"))


_PUBLISHED = "case event_id % 5 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then 'Mon, 02 Feb 2026 10:00:00 GMT' when 2 then '' when 3 then '20260201T000000Z' end"
_COLLECTED = "strftime(ts + interval 1 hour, '%Y-%m-%d %H:%M:%S')"
_ISO = "case when regexp_matches(trim({x}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(trim({x}) as timestamp) end"


def _dated(spark, d):
    n, ts = F.col("event_id") % 5, F.col("ts").cast("timestamp")
    published = F.when(n == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(n == 1, "Mon, 02 Feb 2026 10:00:00 GMT").when(n == 2, "").when(n == 3, "20260201T000000Z")
    return table(spark, d, "events").select("event_id", published.alias("p"), F.date_format(ts + F.expr("interval 1 hour"), "yyyy-MM-dd HH:mm:ss").alias("c"))


@query(f"""with r as (select event_id, {_PUBLISHED} as p, {_COLLECTED} as c from events) select 'plain' as listing, event_id, (row_number() over (order by {_ISO.format(x="coalesce(nullif(p, ''), c)")} desc nulls last, c desc nulls last, event_id))::int as turn from r qualify turn <= 50
 union all select 'shown', event_id, (row_number() over (order by ({_ISO.format(x='p')} is not null)::int desc, coalesce({_ISO.format(x='p')}, {_ISO.format(x='c')}) desc nulls last, event_id))::int as turn from r qualify turn <= 50""")
def listing_orders(spark, d):
    """The first fifty of two listings: what is no ISO date comes last in one, what has no date of publication in the other."""
    rows, out = _dated(spark, d), None
    for name, order in (("plain", intake.listing_order(F.col("p"), F.col("c"))), ("shown", intake.shown_order(F.col("p"), F.col("c")))):
        top = rows.orderBy(*order, "event_id").limit(50).withColumn("turn", F.row_number().over(Window.orderBy(*order, "event_id"))).select(F.lit(name).alias("listing"), "event_id", "turn")
        out = top if out is None else out.union(top)
    return out


_MODE = "case when trim(coalesce(text, '')) = '' then 'afirmacion' when ends_with(text, '?') or starts_with(text, '¿') or starts_with(lower(text), 'qué ') or starts_with(lower(text), 'que ') then 'pregunta' else 'afirmacion' end"


@query(f"""with c as (select conv_id, turn, text from conversations), m as (select doc_id as conv_id from labels where toxic = 0)
select 'members' as asked, conv_id, turn from c where conv_id in (select * from m) and contains(lower(text), 'en') union all select 'nobody', conv_id, turn from c where contains(lower(text), 'the') union all select 'questions', conv_id, turn from c where {_MODE} = 'pregunta'""")
def claims_chosen(spark, d):
    """Claims of a narrative's members; a narrative without members filters nothing."""
    c, m = table(spark, d, "conversations"), table(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("conv_id"))
    named = lambda name, t: t.select(F.lit(name).alias("asked"), "conv_id", "turn")
    return named("members", intake.chosen_claims(c, "conv_id", m, "EN")).union(named("nobody", intake.chosen_claims(c, "conv_id", m.limit(0), "The"))).union(named("questions", intake.chosen_claims(c, "conv_id", m.limit(0), mode="pregunta", modality=text.modality(F.col("text")))))


@query("""with old as (select o_orderkey as claim_id, o_orderstatus as text, 'Unknown' as nli_label, '' as verdict, 0.35::double as confidence from orders where o_orderkey % 3 = 0), new as (select l_orderkey as claim_id, l_returnflag as text, l_linestatus as nli_label, l_returnflag as verdict, (l_linenumber / 10.0)::double as confidence, l_linenumber as w from lineitem where l_orderkey % 2 = 0),
r as (select *, 0 as turn, null as w from old union all select claim_id, text, nli_label, verdict, confidence, 1, w from new)
select claim_id, arg_min(text, (turn, coalesce(w, 0), text, nli_label, verdict, confidence)) as text, arg_max(nli_label, (turn, coalesce(w, 0), text, nli_label, verdict, confidence)) as nli_label, arg_max(verdict, (turn, coalesce(w, 0), text, nli_label, verdict, confidence)) as verdict, arg_max(confidence, (turn, coalesce(w, 0), text, nli_label, verdict, confidence)) as confidence from r group by claim_id""")
def mirror_merged(spark, d):
    """Claims of the mirror after rows came again: only label, verdict and confidence are taken over."""
    old = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderstatus").alias("text"), F.lit("Unknown").alias("nli_label"), F.lit("").alias("verdict"), F.lit(0.35).alias("confidence"))
    new = table(spark, d, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("claim_id"), F.col("l_returnflag").alias("text"), F.col("l_linestatus").alias("nli_label"), F.col("l_returnflag").alias("verdict"), (F.col("l_linenumber") / 10).cast("double").alias("confidence"), F.col("l_linenumber").alias("at"))
    return intake.mirrored(old, new, "claims", "claim_id", "at")


@query("""select page_id, page_id % 3 = 0 or page_id in (select doc_id from documents where doc_id % 4 = 0) as there from pages""")
def hashes_present(spark, d):
    """Which addresses the store or the mirror knows by their hash."""
    asked = table(spark, d, "pages").select("page_id", F.sha2(F.col("page_id").cast("string"), 256).alias("url_hash"))
    store = asked.where("page_id % 3 = 0").select("url_hash")
    mirror = table(spark, d, "documents").where("doc_id % 4 = 0").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("url_hash"))
    return intake.present(asked, "url_hash", store, mirror).select("page_id", "there")


@query("""with p as (select page_id, length(html) as w, 'p' || page_id % 60 as path from pages), t as (select path, max(w) as w, 0 as tier from p where page_id % 3 = 0 group by path union all select path, max(w), 1 from p where page_id % 3 = 1 group by path union all select path, max(w), 2 from p where page_id % 3 = 2 group by path),
k as (select * from (select *, row_number() over (partition by tier order by w desc, path) as r from t) where tier > 0 or r <= 8), o as (select path, min({tier: tier, w: w}) as b from k group by path)
select path, b.tier as tier, turn::int as turn from (select *, row_number() over (order by b.tier, b.w desc, path) as turn from o) where turn <= 20""")
def photos_shown(spark, d):
    """Stills, thumbnails and pictures to show, each once."""
    p = table(spark, d, "pages").select("page_id", F.length("html").alias("at"), F.concat(F.lit("p"), (F.col("page_id") % 60).cast("string")).alias("path"))
    part = lambda i: p.where(F.col("page_id") % 3 == i).select("path", "at")
    return intake.photo_samples(part(0), part(1), part(2), 20)


@query("""with r as (select lower(coalesce(lang, '')) as f, count(*) as n, count(*) filter (where length(coalesce(text, '')) < 500) as bare from documents group by 1), t as (select sum(n) as total, sum(n) filter (where f in ('en', 'fr')) as fed, sum(n) filter (where f = 'de') as seeded, sum(bare) as bare from r)
select total::bigint as total, fed::bigint as fed, seeded::bigint as seeded, bare::bigint as no_body, round_even(fed * 100.0 / total, 0)::bigint as fed_percent, round_even(seeded * 100.0 / total, 0)::bigint as seeded_percent, round_even(bare * 100.0 / total, 0)::bigint as no_body_percent, (select string_agg(f || ':' || n, ',' order by f) from r) as by_format from t""")
def capture_by_format(spark, d):
    """How complete documents are, by the language they came in."""
    rows = table(spark, d, "documents").select(F.col("lang").alias("raw_format"), "text")
    out = intake.capture(rows, ("de",), ("en", "fr"))
    return out.withColumn("by_format", F.array_join(F.transform(F.map_entries("by_format"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))
