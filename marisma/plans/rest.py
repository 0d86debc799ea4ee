"""Queries of smaller rules: patches, comparisons, places of claims, pictures of pages, orders of narratives."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.functions import geo, pictures
from marisma.operators import filters, gazetteer, surveillance
from marisma.plans import surveillance as narrated
from marisma.plans.articles import ARTICLES, _RELEVANCE, articles, judged
from marisma.plans.assessment import _CLAIMS, _claims
from marisma.plans.places import _COUNTRY_LIST, _HEARD, _PLACE_CASE
from marisma.sinks import tables
from marisma.sources import pages
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with c as (select doc_id, [trim(x) for x in string_split(concat_ws(',', lang, ' ' || source || ' ', lang, '', left(source, 4)), ',')] as parts from documents)
select doc_id, array_to_string(list_reduce(list_prepend([]::varchar[], [[x] for x in parts if x <> '']), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end), '|') as ids from c""")
def compared_ids(spark, d):
    """Ids to compare, each once and in order."""
    raw = F.concat_ws(",", "lang", F.concat(F.lit(" "), "source", F.lit(" ")), "lang", F.lit(""), F.substring("source", 1, 4))
    return table(spark, d, "documents").select("doc_id", F.array_join(filters.compare_ids(raw), "|").alias("ids"))


@query("""select c_custkey, c_name, case when c_custkey % 5 = 0 and c_custkey % 2 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal, case when c_custkey % 5 = 0 then 'X' else c_mktsegment end as c_mktsegment from customer""")
def patch_allowed(spark, d):
    """Customers with the values of a patch in the columns that may change; its names and nulls change nothing."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 5 = 0 or c_custkey % 7 = 9").select("c_custkey", F.lit("other").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("X").alias("c_mktsegment"), F.lit(1).alias("strange"))
    return tables.patched(c, new, ["c_custkey"], ["c_acctbal", "c_mktsegment"])


@query(f"""with {narrated._ROWS} select narrative, volume::bigint as volume, growth from (select narrative, volume, case when gr.c >= 4 then round((q - greatest(p, 1)) * 100.0::double / greatest(p, 1), 1) else 100.0 end as growth from who left join gr using (narrative)) order by volume desc, growth desc, narrative limit 3""")
def narratives_first(spark, d):
    """The largest narratives, of equal ones those that grow most."""
    out = surveillance.characterize(narrated._matched(spark, d), "narrative", "doc_id", "day", "country", "source", "name")
    return out.select("narrative", "volume", "growth").orderBy(F.desc("volume"), F.desc("growth"), "narrative").limit(3)


_NEEDLE = "MX"


@query(f"""with e as (select doc_id, string_agg(location, ' ' order by turn) as extra from {_CLAIMS} where turn <= 6 group by doc_id), a as (select x.doc_id, country, title, concat_ws(chr(10), country, title, coalesce(extra, ''), text) as blob from {ARTICLES} x left join e using (doc_id)),
h as (select doc_id, country, upper(trim(country)) as raw, {_HEARD} as h from (select *, lower(blob) as b from a)), p as (select *, {_PLACE_CASE} as named, {_COUNTRY_LIST} as cs from h),
r as (select *, case when raw in {tuple(c[0] for c in geo.COUNTRIES if c[0] not in geo.NOWHERE)} then raw when named is not null then left(named, 2) else coalesce(cs[1], 'XX') end as code from p)
select doc_id, code, code = '{_NEEDLE}' or raw = '{_NEEDLE}' or left(raw, 2) = '{_NEEDLE}' as matches from r""")
def country_matches(spark, d):
    """Which articles are of a country: by the stored one, or by what their texts and the places of their claims name."""
    claims = _claims(spark, d).where("turn <= 6").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "location"))), lambda c: c["location"]), " ").alias("extra"))
    a = articles(spark, d).join(claims, "doc_id", "left").select("doc_id", "country", F.concat_ws("\n", "country", "title", F.coalesce("extra", F.lit("")), "text").alias("blob"))
    found = gazetteer.spans(a, F.col("blob"), geo.terms(), keep=["doc_id", "country"]).select("doc_id", "country", geo.heard(F.col("found")).alias("h"))
    raw = F.upper(F.trim("country"))
    # the country of an article is its stored code before any place
    known = F.array_contains(F.array(*[F.lit(c[0]) for c in geo.COUNTRIES]), raw) & ~raw.isin(*geo.NOWHERE)
    rows = found.select("doc_id", raw.alias("raw"), F.when(known, raw).otherwise(geo.resolved(F.lit(""), F.col("h"))["country"]).alias("code"))
    return rows.select("doc_id", "code", ((F.col("code") == _NEEDLE) | (F.col("raw") == _NEEDLE) | (F.substring("raw", 1, 2) == _NEEDLE)).alias("matches"))


@query(f"""select doc_id, case when skip then 'discard' when score < 0.5 then 'low' when score < 0.8 then 'analyze' else 'high' end as bucket, 'unclassified' as narrative_type from {_RELEVANCE}""")
def narrative_types(spark, d):
    """Articles with the bucket of their relevance; no model tells their type yet."""
    return judged(articles(spark, d)).select("doc_id", "bucket", F.lit("unclassified").alias("narrative_type"))


@query(f"""with p as (select page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) as root, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(?:/.*/|/)?)', 1) as folder from pages),
f as (select *, case when ends_with(folder, '/') then folder else folder || '/' end as beside from p) select page_id, array_to_string([root || '/og/' || page_id || '.jpg', 'https://cdn.net/t.png', beside || 'pic' || page_id || '.jpg', 'http://x.net/lazy.webp'], ' ') as pictures from f""")
def pictures_of_pages(spark, d):
    """Pictures of pages: of meta tags first, whole addresses, without small ones, icons and drawn ones."""
    n = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<meta property="og:image" content="/og/'), n, F.lit('.jpg"><meta content=\'//cdn.net/t.png\' name=\'twitter:image\'><img src="pic'), n, F.lit('.jpg" width="640"><img width="32" src="/small.jpg"><img data-src="http://x.net/lazy.webp" height="90"><img src="/logo.png"><img src="data:image/png;x"><img src="/d.svg"><img src="pic'), n,
        F.lit('.jpg">'), F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(img|meta)\b[^>]*>", ""),
    )
    return table(spark, d, "pages").select("page_id", F.array_join(pages.preview_pictures(html, F.col("url")), " ").alias("pictures"))


@query("""with p as (select page_id, case page_id % 6 when 0 then 'img/Ph_' || page_id || '.png' when 1 then 'a.svg' when 2 then 'corpus_' || page_id || '.png' when 3 then 'Casos' || page_id || '.jpg' when 4 then 'photo' || page_id || '.png' else 'photo.tiff' end as k, (page_id % 130)::int as w from pages),
n as (select *, lower(regexp_extract(k, '([^/]*)$', 1)) as name from p) select page_id, not starts_with(name, 'ph_') and not ends_with(name, '.svg') and not starts_with(name, 'corpus_') as displayable, regexp_matches(name, '\\.(jpg|jpeg|png|webp|bmp|gif)$') and (regexp_matches(name, 'fb_|demo_seed_|corpus_|casos|ph_') or (w > 0 and w <= 64 and ends_with(name, '.png'))) as purged from n""")
def pictures_kept(spark, d):
    """Which pictures of an article can be shown, and which go from the training set."""
    n = F.col("page_id")
    number, m = n.cast("string"), n % 6
    key = F.when(m == 0, F.concat(F.lit("img/Ph_"), number, F.lit(".png"))).when(m == 1, "a.svg").when(m == 2, F.concat(F.lit("corpus_"), number, F.lit(".png"))).when(m == 3, F.concat(F.lit("Casos"), number, F.lit(".jpg"))).when(m == 4, F.concat(F.lit("photo"), number, F.lit(".png"))).otherwise("photo.tiff")
    side = (n % 130).cast("int")
    return table(spark, d, "pages").select("page_id", pictures.is_displayable(number, key, F.lit(""), F.lit("")).alias("displayable"), pictures.is_purged(key, side, side).alias("purged"))
