"""Pages and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.functions import text, urls
from marisma.operators import facets, filters, relations
from marisma.sources import pages as web
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(spark, d):
    return table(spark, d, "pages")


_HOST = "regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
_PATH = "regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_COLLAPSE = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0b\\x{{a0}}]+', ' ', 'g'))"


@query(f"select page_id, {_HOST} as host, {_HOST} || regexp_replace({_PATH}, '/+$', '') as canonical from pages")
def url_host_canonical(spark, d):
    return _pages(spark, d).select("page_id", urls.host(F.col("url")).alias("host"), urls.canonical(F.col("url")).alias("canonical"))


@query(f"select {_HOST} as host, count(*)::bigint as n from pages group by 1")
def host_counts(spark, d):
    return _pages(spark, d).groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


_DOMAINS = ("example.com", "example.org", "com", "nowhere.test")


@query(f"with h as (select {_HOST} as host, count(*)::bigint as n from pages group by 1) select domain, coalesce(max(n), 0)::bigint as uses from (values " + ", ".join(f"('{x}')" for x in _DOMAINS) + ") as t(domain) left join h on host = domain or suffix(host, '.' || domain) group by domain")
def host_suffix_join(spark, d):
    h = _pages(spark, d).groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return relations.under_domain(h, spark.createDataFrame([(x,) for x in _DOMAINS], "domain string"), "host", "domain", "n")


@query(f"""select page_id, {_HOST} = 'example.org' or suffix({_HOST}, '.example.org') as official, regexp_matches(trim(url), '^https?://[^/?#]+\\.[^/?#]+') as is_public, {_HOST} <> '' and regexp_matches(regexp_replace({_PATH}, '/+$', ''), '^(/(index|home|inicio)(\\.[a-z]+)?)?$') as homepage from pages""")
def url_official_public(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", urls.under(urls.host(u), ["example.org"]).alias("official"), urls.public(u).isNotNull().alias("is_public"), urls.is_homepage(u).alias("homepage"))


@query("""select page_id, case when contains(lower(url), 'youtube') or contains(lower(url), 'youtu.be') then 'youtube' when contains(lower(url), 'openalex.org') or contains(lower(url), 'pubmed') or contains(lower(url), 'doi.org') then 'cientifico'
 when contains(lower(url), 'woah.org') or contains(lower(url), 'oie.int') or contains(lower(url), 'senasica') or contains(lower(url), 'gob.mx') or contains(lower(url), 'fao.org') or contains(lower(url), 'who.int') or contains(lower(url), 'cdc.gov') or contains(lower(url), 'usda.gov') then 'oficial'
 when contains(lower(url), 'twitter.com') or contains(lower(url), 'x.com') or contains(lower(url), 'facebook.com') or contains(lower(url), 'linkedin.com') or contains(lower(url), 'reddit.com') then 'social' else 'prensa' end as origin from pages""")
def origin_case(spark, d):
    return _pages(spark, d).select("page_id", filters.origin(F.col("url"), F.lit(""), F.lit("")).alias("origin"))


@query(f"select page_id, length({_COLLAPSE.format('''regexp_replace(html, '<[^>]+>', ' ', 'g')''')})::bigint as n, substr({_COLLAPSE.format('''regexp_replace(html, '<[^>]+>', ' ', 'g')''')}, 1, 50) as head from pages")
def html_strip(spark, d):
    flat = text.strip_html(F.col("html"))
    return _pages(spark, d).select("page_id", F.length(flat).cast("long").alias("n"), F.substring(flat, 1, 50).alias("head"))


@query(f"select page_id, {_COLLAPSE.format('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')} as title from pages")
def html_title(spark, d):
    return _pages(spark, d).select("page_id", F.coalesce(web.title(F.col("html")), F.lit("")).alias("title"))


def _main_sql() -> str:
    x = "html"
    for tag in ("script", "style", "nav", "footer", "header", "aside", "form", "noscript"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    return _COLLAPSE.format(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")


@query(f"select page_id, case when length(t) <= 20000 then t else regexp_replace(substr(t, 1, 20000), '\\s+\\S*$', '') end as main from (select page_id, {_main_sql()} as t from pages)")
def html_main_text(spark, d):
    return _pages(spark, d).select("page_id", web.main_text(F.col("html")).alias("main"))


@query("""select page_id, len(r)::bigint as images, coalesce(list_extract(r, 1), '') as first from (select page_id, list_filter(list_transform(regexp_extract_all(html, '(?i)<img\\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\\bsrc=["'']([^"'']*)["'']', 1)), lambda s: s <> '') as r from pages)""")
def html_img_refs(spark, d):
    r = text.image_refs(F.col("html"))
    return _pages(spark, d).select("page_id", r.alias("r")).select("page_id", F.size("r").cast("long").alias("images"), F.coalesce(F.try_element_at("r", F.lit(1))["src"], F.lit("")).alias("first"))


@query(f"""select page_id, pos::int as pos, href from (select page_id, unnest(range(len(l))) as pos, unnest(l) as href from (select page_id, list_slice(list_filter(list_distinct_ordered, lambda h: {_HOST.replace('url', 'h')} = host or h like '/%'), 1, 12) as l from (
 select page_id, {_HOST} as host, list_reduce(list_prepend([]::varchar[], list_transform(regexp_extract_all(html, '(?i)<a\\b[^>]*href=["'']([^"''#]+)["'']', 1), lambda x: [x])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end) as list_distinct_ordered from pages)))""")
def html_links_samehost(spark, d):
    return web.listing(_pages(spark, d), "page_id", "url", 12)


@query("""select page_id, len(u)::bigint as n from (select page_id, list_slice(list_distinct(list_filter(list_concat(regexp_extract_all(html, '(?i)<meta[^>]*(?:property|name)=["'']og:image["''][^>]*content=["'']([^"'']+)["'']', 1), regexp_extract_all(html, '(?i)<meta[^>]*(?:property|name)=["'']twitter:image["''][^>]*content=["'']([^"'']+)["'']', 1),
 list_filter(list_transform(regexp_extract_all(html, '(?i)<img\\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\\bsrc=["'']([^"'']*)["'']', 1)), lambda s: s <> '')), lambda s: not regexp_matches(lower(s), '^data:|favicon|sprite|\\.svg$'))), 1, 8) as u from pages)""")
def preview_images(spark, d):
    return _pages(spark, d).select("page_id", F.size(web.preview_images(F.col("html"))).cast("long").alias("n"))


@query(f"select host, page_id, turn::int as turn from (select {_HOST} as host, page_id, row_number() over (partition by {_HOST} order by page_id) as turn from pages where {_HOST} <> '') where turn <= 4")
def host_distinct_cap(spark, d):
    p = _pages(spark, d).select(urls.host(F.col("url")).alias("host"), "page_id").where("host <> ''")
    return facets.top_per_group(p, ["host"], [F.col("page_id")], 4)


@query("select page_id, regexp_extract(replace(url, 'example.com/en/', 'youtu.be/AAAAAAAA'), '(?:youtu\\.be/|[?&]v=|/embed/|/shorts/)([A-Za-z0-9_-]{11})', 1) as video from pages")
def youtube_id(spark, d):
    return _pages(spark, d).select("page_id", urls.youtube_id(F.replace("url", F.lit("example.com/en/"), F.lit("youtu.be/AAAAAAAA"))).alias("video"))


@query("select page_id, case when regexp_matches(lower(url), 'spam|pills') then 'POTENTIALLY_MANIPULATED' when regexp_matches(lower(url), 'blog') then 'SOCIAL_MEDIA' when regexp_matches(lower(url), '\\.html') then 'NEWS_SCREENSHOT' else 'PHOTOGRAPH' end as visual from pages")
def url_visual_class(spark, d):
    u = F.lower("url")
    return _pages(spark, d).select("page_id", F.when(u.rlike("spam|pills"), "POTENTIALLY_MANIPULATED").when(u.rlike("blog"), "SOCIAL_MEDIA").when(u.rlike(r"\.html"), "NEWS_SCREENSHOT").otherwise("PHOTOGRAPH").alias("visual"))


_OUT = "html"
for _t in web.FURNITURE:
    _OUT = f"regexp_replace({_OUT}, '(?is)<{_t}\\b.*?</{_t}>', ' ', 'g')"


@query(f"""with a as (select page_id, {_OUT} as bare from pages), f as (select page_id, {_COLLAPSE.format("regexp_replace(regexp_extract(bare, '(?is)<article\\b[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g')")} as own,
 {_COLLAPSE.format("regexp_replace(regexp_extract(bare, '(?is)<body\\b[^>]*>(.*)</body>', 1), '<[^>]+>', ' ', 'g')")} as body, {_COLLAPSE.format("regexp_replace(bare, '<[^>]+>', ' ', 'g')")} as whole from a),
t as (select page_id, case when length(own) > 200 then own when body <> '' then body else whole end as t from f)
select page_id, sha256(case when length(t) <= 20000 then t else regexp_replace(substr(t, 1, 20000), '\\s+\\S*$', '') end) as article_sha256 from t""")
def page_article(spark, d):
    """In these pages an article element is the only place of an article; without a long one the body counts."""
    return _pages(spark, d).select("page_id", F.sha2(web.article_text(F.col("html")), 256).alias("article_sha256"))


@query(f"""with a as (select page_id, url, unnest(range(len(l))) as pos, unnest(l) as a from (select page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*href=["''][^"'']+["''][^>]*>.*?</a>') as l from pages)),
h as (select page_id, url, pos, trim(regexp_extract(a, '(?is)href=["'']([^"'']+)["'']', 1)) as href, {_COLLAPSE.format("regexp_replace(a, '<[^>]+>', ' ', 'g')")} as title from a),
k as (select page_id, url, pos, case when href like '//%' then 'https:' || href when href like '/%' then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href else href end as href, title from h where not regexp_matches(lower(href), '/login|/privacy|/cookie|/tag/|/tags/|/share|javascript:|mailto:|#')),
j as (select *, lower(regexp_extract(href, '^https?://([^/?#:]*)', 1)) as hh, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) as uh from k),
g as (select page_id, href, min(pos) as pos from (select page_id, pos, href, case when title = '' then href else title end as title, url from j where href like 'http%' and (uh = '' or hh = '' or hh = uh or ends_with(hh, '.' || uh))) where rtrim(href, '/') <> rtrim(url, '/') and length(title) >= 6 group by 1, 2)
select page_id, (turn - 1)::int as pos, href from (select *, row_number() over (partition by page_id order by pos) as turn from g) where turn <= 12""")
def listing_links(spark, d):
    """Texts of links are short in these pages: six characters are asked for."""
    return web.article_links(_pages(spark, d), "page_id", "url", 12, shortest=6).select("page_id", "pos", "href")


@query("""with i as (select conv_id, turn, role, text, 'http://p/' || conv_id as url, conv_id * 100 + turn as id from conversations), p as (select 'http://p/' || doc_id as url, text as page_text from documents),
g as (select i.*, page_text, length(i.text) < 400 and length(page_text) > length(i.text) as gain from i left join p using (url)), r as (select id, row_number() over (partition by role order by id) as turn from g where gain)
select g.id, coalesce(r.turn <= 20, false) as completed, sha256(case when r.turn <= 20 then page_text else g.text end) as text_sha256 from g left join r using (id)""")
def body_completed(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", "text", F.concat(F.lit("http://p/"), F.col("conv_id").cast("string")).alias("url"))
    p = table(spark, d, "documents").select(F.concat(F.lit("http://p/"), F.col("doc_id").cast("string")).alias("url"), "text")
    out = web.completed(c, p, "id", "role", "url", "text")
    return out.select("id", "completed", F.sha2("text", 256).alias("text_sha256"))
