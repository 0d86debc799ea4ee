"""Queries of row numbers, lookups, the list of sources, aligned series and ties by first appearance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marisma.functions import urls
from marisma.operators import catalog, lexicon, numbering, series
from marisma.plans.articles import _HOST
from marisma.plans.kit import LEXICON, SENTENCES, docs, hits_sql, lexicon_sql
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_IDS = "select doc_id, 'CNT-' || substr(sha256(doc_id || ':' || coalesce(text, '')), 1, 12) as content_id, row_number() over (order by doc_id) as number, row_number() over (order by n_chars desc, doc_id) as place from documents"
_TYPED = """case doc_id // 20 % 8 when 0 then content_id when 1 then 'cnt-' || upper(substr(content_id, 5)) when 2 then substr(content_id, 5) when 3 then (doc_id * 3)::varchar when 4 then ' CNT%2D' || substr(content_id, 5) || '%20' when 5 then '' when 6 then 'no such text' else '0' || (doc_id + 7) end"""


@query(f"""with t as ({_IDS}), q as (select doc_id, {_TYPED} as typed from t where doc_id % 20 = 0), r as (select *, trim(url_decode(typed)) as raw from q),
c as (select doc_id, 0 as turn, raw as c from r where raw <> '' union all select doc_id, 1, 'CNT-' || substr(raw, 5) from r where lower(raw) like 'cnt-%' union all select doc_id, 2, 'cnt-' || substr(raw, 5) from r where lower(raw) like 'cnt-%'
 union all select doc_id, 3, substr(raw, 5) from r where lower(raw) like 'cnt-%' union all select doc_id, 1, 'CNT-' || raw from r where regexp_matches(raw, '^[a-zA-Z0-9]+$')),
d as (select doc_id, c, row_number() over (partition by doc_id order by min(turn)) - 1 as turn from c where c <> '' group by doc_id, c),
f as (select d.doc_id, 2 * turn + case when c = content_id then 0 else 1 end as how, content_id from d join t on lower(c) = lower(content_id) union all select r.doc_id, 100, t.content_id from r join t on regexp_matches(raw, '^[0-9]+$') and number = try_cast(raw as bigint) union all select r.doc_id, 101, t.content_id from r join t on regexp_matches(raw, '^[0-9]+$') and place = try_cast(raw as bigint)),
b as (select doc_id, min(how) as how, arg_min(content_id, (how, content_id)) as content_id from f group by doc_id)
select q.doc_id, typed, content_id, how::int as how from q left join b using (doc_id)""")
def article_resolved(spark, d):
    """Articles found by id, in any case, with or without its prefix, by the number of their row or their place in the listing."""
    ids = table(spark, d, "documents").select("doc_id", "n_chars", F.concat(F.lit("CNT-"), F.substring(F.sha2(F.concat_ws(":", "doc_id", F.coalesce("text", F.lit(""))), 256), 1, 12)).alias("content_id"))
    rows = numbering.numbered(numbering.numbered(ids, [F.col("doc_id")], "number"), [F.desc("n_chars"), F.col("doc_id")], "place")
    n, tail = F.floor(F.col("doc_id") / 20) % 8, F.substring("content_id", 5, 12)
    typed = F.when(n == 0, F.col("content_id")).when(n == 1, F.concat(F.lit("cnt-"), F.upper(tail))).when(n == 2, tail).when(n == 3, (F.col("doc_id") * 3).cast("string")).when(n == 4, F.concat(F.lit(" CNT%2D"), tail, F.lit("%20"))).when(n == 5, "").when(n == 6, "no such text").otherwise(F.concat(F.lit("0"), (F.col("doc_id") + 7).cast("string")))
    asked = rows.where("doc_id % 20 = 0").select("doc_id", typed.alias("typed"))
    return numbering.resolved(asked, "typed", rows, "content_id", "number", "place").select("doc_id", "typed", "content_id", "how")


_IMAGES = f"select page_id, 'IMG-' || substr(sha256(url), 1, 16) as image_id, lower(regexp_replace(url, '^[a-z]+://', '')) as storage_key, sha256(coalesce(html, '')) as digest from pages"


@query(f"""with i as ({_IMAGES}), q as (select page_id, case page_id // 5 % 4 when 0 then image_id when 1 then substr(storage_key, 3, 14) when 2 then substr(digest, 1, 9) else '1234567' end as typed from i where page_id % 5 = 0),
f as (select q.page_id, 0 as how, image_id from q join i on typed = image_id union all select q.page_id, 1, image_id from q join i on length(typed) >= 6 and not regexp_matches(typed, '^[0-9]+$') and (contains(storage_key, lower(typed)) or starts_with(digest, lower(typed)))),
b as (select page_id, min(how) as how, arg_min(image_id, (how, image_id)) as image_id from f group by page_id) select q.page_id, typed, image_id, how::int as how from q left join b using (page_id)""")
def image_resolved(spark, d):
    """Images found by id, by a part of where they are stored, by the beginning of their digest."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("IMG-"), F.substring(F.sha2("url", 256), 1, 16)).alias("image_id"), F.lower(F.regexp_replace("url", "^[a-z]+://", "")).alias("storage_key"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    n = F.floor(F.col("page_id") / 5) % 4
    asked = p.where("page_id % 5 = 0").select("page_id", F.when(n == 0, F.col("image_id")).when(n == 1, F.substring("storage_key", 3, 14)).when(n == 2, F.substring("digest", 1, 9)).otherwise("1234567").alias("typed"))
    return numbering.resolved_images(asked, "typed", p, "image_id", "storage_key", "digest").select("page_id", "typed", "image_id", "how")


SECTIONS = ("OFFICIAL", "news", "RESEARCH", "YouTube", "FORUM", "other")
CATEGORIES = ("veterinary", "media", "social", "other")
_SECTION = "[" + ", ".join(f"'{s}'" for s in SECTIONS) + "][page_id % 6 + 1]"
_CAT = "[" + ", ".join(f"'{s}'" for s in CATEGORIES) + "][page_id // 2 % 4 + 1]"
_SRC_HOST = "case when page_id % 40 = 0 then 'senasica.gob.mx' when page_id % 30 = 1 then 'woah.org' else host end"


@query(f"""with p as (select page_id, {_HOST} as host from pages), i as (select page_id, {_SRC_HOST} as domain, case when page_id % 3 = 0 then 'N' || page_id end as name, case page_id % 4 when 0 then 'MX' when 1 then 'fr' end as country, case page_id % 5 when 0 then 'de, en' when 1 then '' end as lang,
 case page_id % 7 when 0 then 'API' when 1 then 'web' when 2 then 'rss' when 3 then 'ftp' end as how, case when page_id % 11 = 0 then 'http://f/' || page_id else '' end as rss, case page_id % 13 when 0 then ' b ' when 1 then 'Z' end as grade, {_SECTION} as section, {_CAT} as category from p),
f as (select * from (select *, row_number() over (partition by domain order by page_id) as turn from i where domain <> '') where turn = 1), n as (select *, row_number() over (order by page_id) as number from f)
select 'SRC' || case when number < 1000 then lpad(number::varchar, 3, '0') else number::varchar end as source_id, coalesce(name, domain) as name, domain, coalesce(country, 'INT') as country, case when coalesce(lang, '') <> '' then trim(split_part(lang, ',', 1)) when upper(coalesce(country, '')) = 'MX' then 'es' else 'und' end as language,
 case when rss <> '' then 'rss' when lower(how) = 'web' then 'scrape' when lower(how) in ('api', 'rss', 'scrape') then lower(how) else 'scrape' end as access_method,
 case when upper(trim(coalesce(grade, ''))) in ('A', 'B', 'C', 'D', 'E', 'F') then upper(trim(grade)) when regexp_matches(domain, '(^|\\.)(woah\\.org|gob\\.mx)$') then 'A' when upper(section) = 'OFFICIAL' then 'A' when upper(section) = 'RESEARCH' then 'B' when category = 'veterinary' then 'B' when upper(section) = 'YOUTUBE' then 'D'
  when upper(section) = 'FORUM' or category = 'social' then 'E' when upper(section) = 'NEWS' or category = 'media' then 'C' else '' end as authority, case when rss <> '' then 'none' else 'html' end as scraper_type from n""")
def catalog_generated(spark, d):
    """Sources of the hosts of pages: the first page of each tells what is known of it; numbers follow that order."""
    n = F.col("page_id")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    host = F.when(n % 40 == 0, "senasica.gob.mx").when(n % 30 == 1, "woah.org").otherwise(urls.host(F.col("url")))
    items = table(spark, d, "pages").select(
        "page_id", F.when(n % 2 == 0, F.array(host)).alias("domains"), F.array(F.concat(host, F.lit("/news/x"))).alias("patterns"), F.when(n % 3 == 0, F.concat(F.lit("N"), n.cast("string"))).alias("name"), F.when(n % 4 == 0, "MX").when(n % 4 == 1, "fr").alias("country"),
        F.when(n % 5 == 0, "de, en").when(n % 5 == 1, "").alias("language"), F.when(n % 7 == 0, "API").when(n % 7 == 1, "web").when(n % 7 == 2, "rss").when(n % 7 == 3, "ftp").alias("access_method"), F.when(n % 11 == 0, F.concat(F.lit("http://f/"), n.cast("string"))).otherwise("").alias("rss_url"),
        F.when(n % 13 == 0, " b ").when(n % 13 == 1, "Z").alias("source_authority"), pick(SECTIONS, n % 6).alias("section"), pick(CATEGORIES, F.floor(n / 2) % 4).alias("category"),
    )
    return catalog.generated(items, "page_id")


@query("""with s as (select s_suppkey, s_acctbal, case s_suppkey % 3 when 0 then 'rss' when 1 then 'scrape' end as method from supplier)
select s_suppkey, method, false as late from s where method = 'rss' union all select * from (select s_suppkey, method, true from s where coalesce(method, 'scrape') = 'scrape' order by s_acctbal, s_suppkey limit 10)""")
def due_in_turn(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.struct("s_acctbal", "s_suppkey").alias("turn"), F.when(F.col("s_suppkey") % 3 == 0, "rss").when(F.col("s_suppkey") % 3 == 1, "scrape").alias("method"))
    return catalog.due_in_turn(s, "method", "turn", 10).select("s_suppkey", "method", "late")


@query(f"""with h as (select {_HOST} as host, count(*) as n from pages group by 1), s as (select distinct case when hash_of % 3 = 0 then 'www.' || host when hash_of % 3 = 1 then 'news.' || host else regexp_replace(host, '^[^.]+\\.', '') end as domain from (select host, length(host) as hash_of from h where host <> ''))
select domain, coalesce((select max(n) from h where host <> '' and (host = d or ends_with(host, '.' || d) or ends_with(d, '.' || host))), 0)::bigint as uses from (select domain, regexp_replace(lower(domain), '^www\\.', '') as d from s)""")
def evidence_uses(spark, d):
    """How often a source's host, one under it or one above it is used: the most used one counts."""
    h = table(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    n = F.length("host") % 3
    s = h.where("host <> ''").select(F.when(n == 0, F.concat(F.lit("www."), "host")).when(n == 1, F.concat(F.lit("news."), "host")).otherwise(F.regexp_replace("host", r"^[^.]+\.", "")).alias("domain")).distinct()
    return catalog.evidence_uses(s, "domain", h, "host", "n")


@query("""with n as (select p_name as label, p_brand as keywords, p_retailprice - 1000 as g from part), a as (select c_custkey, case c_custkey % 4 when 0 then [] when 1 then ['small_ring'] when 2 then ['Brand#' || (c_custkey % 25), 'zzz'] else ['nothing at all'] end as needles from customer),
w as (select c_custkey, replace(lower(x), '_', ' ') as x from (select c_custkey, unnest(needles) as x from a)), d as (select distinct x from w), m as (select x, max(g) as g from d join n on contains(lower(label || ' ' || keywords), x) group by x)
select c_custkey, greatest(0, case when len(any_value(needles)) = 0 then (select max(g) from n) else coalesce(max(g), 0) end)::double as growth from a left join w using (c_custkey) left join m using (x) group by c_custkey""")
def narrative_growth(spark, d):
    n = table(spark, d, "part").select(F.col("p_name").alias("label"), F.col("p_brand").alias("keywords"), (F.col("p_retailprice") - 1000).alias("growth"))
    k = F.col("c_custkey") % 4
    needles = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("small_ring"))).when(k == 2, F.array(F.concat(F.lit("Brand#"), (F.col("c_custkey") % 25).cast("string")), F.lit("zzz"))).otherwise(F.array(F.lit("nothing at all")))
    return catalog.narrative_growth(table(spark, d, "customer").select("c_custkey", needles.alias("needles")), "c_custkey", "needles", n, "label", "keywords", "growth")


_DAILY = """(select lang as g, date '2026-01-01' + (case lang when 'en' then n_chars % 12 when 'fr' then n_chars % 30 when 'de' then n_chars % 15 * 10 else n_chars % 18 end)::int as day, count(*)::bigint as n from documents where lang is not null group by 1, 2
 union all select 'few', date '2026-01-05', 0 union all select 'fewer', date '2025-12-30', 1)"""


def _daily(spark, d):
    n = F.col("n_chars")
    offset = F.when(F.col("lang") == "en", n % 12).when(F.col("lang") == "fr", n % 30).when(F.col("lang") == "de", n % 15 * 10).otherwise(n % 18)
    rows = docs(spark, d).where("lang is not null").select(F.col("lang").alias("g"), F.date_add(F.lit("2026-01-01").cast("date"), offset.cast("int")).alias("day"))
    few = spark.sql("select 'few' as g, date'2026-01-05' as day, 0L as n union all select 'fewer', date'2025-12-30', 1L")
    return rows.groupBy("g", "day").agg(F.count(F.lit(1)).alias("n")).union(few)


_BUCKETED = f"""live as (select * from {_DAILY} where n > 0), w as (select g, date_diff('day', min(day), max(day)) > 90 or count(*) > 18 as m, sum(n) as total from live group by g), top as (select g, m from w order by total desc, g limit 4),
b as (select g, case when m then strftime(day, '%Y-%m') else strftime(day, '%Y-%m-%d') end as bucket, sum(n)::bigint as n from live join top using (g) group by 1, 2)"""


@query(f"with {_BUCKETED} select s.bucket, top.g, coalesce(b.n, 0)::bigint as n from (select distinct bucket from b) s cross join top left join b on b.bucket = s.bucket and b.g = top.g")
def series_aligned(spark, d):
    """Four series side by side, some by day and some by month, as their span and number of points ask for."""
    return series.aligned(_daily(spark, d), "g", "day", "n")


@query(f"with {_BUCKETED} select bucket, g, n from b order by n desc, bucket, g limit 1")
def series_peak(spark, d):
    return series.peak(series.aligned(_daily(spark, d), "g", "day", "n"), "g")


@query(f"""with l as (select g, date_trunc('week', day)::date as week, sum(n)::bigint as n, count(*) as days from {_DAILY} where n > 0 group by 1, 2), t as (select g, count(*) as weeks, sum(days) as all_days, sum(n) as total from l group by g), r as (select *, row_number() over (partition by g order by n desc, week) as turn from l)
select r.g, r.week, r.n from r join t using (g) where turn = 1 and weeks >= 2 and all_days >= 2 and total >= 4 and n >= 0.45 * total and g in ('en', 'de')""")
def dominant_week(spark, d):
    out = None
    for g in ("en", "de"):
        one = series.dominant_week(_daily(spark, d).where(F.col("g") == g), "day", "n").select(F.lit(g).alias("g"), "week", "n")
        out = one if out is None else out.union(one)
    return out


_FOUND = f"select doc_id, spos, pos, term, category from (select k // 1000000 as doc_id, k % 1000000 as spos, pos, term, category from ({hits_sql(f'(select doc_id * 1000000 + pos as k, s from ({SENTENCES}))', 'k', 's')}))"


@query(f"""with h as ({_FOUND}) select row_number() over (order by n desc, first)::int as place, term, n from (select term, count(*)::bigint as n, min((doc_id, spos, pos)) as first from h group by term) order by n desc, first limit 48""")
def cloud_first_seen(spark, d):
    """The most frequent terms; of equal ones the one that stands first."""
    top = lexicon.most_common(lexicon.first_inserted(lexicon.sentence_hits(docs(spark, d), "doc_id", LEXICON), "doc_id"), 48)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("place"), "term", "n")


@query(f"""with h as ({_FOUND}) select row_number() over (order by n desc, first)::int as place, category, n from (select category, count(*)::bigint as n, min((doc_id, spos, pos)) as first from h group by category)""")
def categories_first_seen(spark, d):
    counts = lexicon.first_inserted(lexicon.sentence_hits(docs(spark, d), "doc_id", LEXICON), "doc_id", "category")
    return counts.select(F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("place"), "category", "n")


_STRUCTURES = {"mixed": (("en", "de"), ()), "spanish": (("es",), ("los ", "una ")), "place": (("lugar", "novedad"), ()), "french": (("fr",), ("sur", "aux"))}


@query(f"""with h as ({_FOUND}), s as (select doc_id, spos, list(category) as c from h group by 1, 2), t as (select s.*, translate(lower(x.s), 'áéíóúüñàâäèêëìîïòôöùûçãõ', 'aeiouunaaaeeeiiiooouucao') as l from s join ({SENTENCES}) x on x.doc_id = s.doc_id and x.pos = s.spos),
g as (""" + " union all ".join(f"select '{k}' as label, doc_id, spos from t where list_has_all(c, [{', '.join(repr(n) for n in need)}])" + (f" and regexp_matches(l, '{'|'.join(words)}')" if words else "") for k, (need, words) in _STRUCTURES.items()) + """)
select label, count(*)::bigint as n, min(doc_id) as first_doc from g group by label""")  # fmt: skip
def structures_found(spark, d):
    """Sentences with all categories of a structure, and one of its words."""
    out = lexicon.structures(lexicon.sentence_hits(docs(spark, d), "doc_id", LEXICON), "doc_id", _STRUCTURES)
    return out.select("label", "n", F.col("first.doc_id").alias("first_doc"))
