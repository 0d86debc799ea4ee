"""Queries of names and places in whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.functions import geo
from marisma.operators import gazetteer
from marisma.plans.articles import ARTICLES, _sql_list, articles
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WORDS = "select doc_id, lower(coalesce(text, '')) as l, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+')) as w from documents"
_STEMS = "select distinct w, left(w, 5) as stem from tokens where regexp_matches(w, '^[a-z]{5,14}$')"


def _terms(spark, d):
    """Two tables of names: stems with all their words as variants, each a word of its own, and the stems alone, found inside words too."""
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+")).alias("w")).where(F.col("w").rlike("^[a-z]{5,14}$"))
    names = words.groupBy(F.substring("w", 1, 5).alias("stem")).agg(F.collect_set("w").alias("words"))
    none = names.withColumn("words", F.array().cast("array<string>"))
    return gazetteer.terms_of(names, "stem", "ORG", "words", word=True).unionByName(gazetteer.terms_of(none, "stem", F.when(F.col("stem") < "m", "COUNTRY").otherwise("STATE"), "words"))


@query(f"""with tokens as ({_WORDS}), names as ({_STEMS}), terms as (select w as term, stem from names union select stem, stem from names),
a as (select doc_id, 'ORG' as kind, stem as canonical, count(*) as n from tokens join terms on w = term group by 1, 3),
places as (select doc_id, l, unnest(range(1, greatest(length(l) - 3, 1))) as i from (select doc_id, lower(coalesce(text, '')) as l from documents)),
b as (select doc_id, case when stem < 'm' then 'COUNTRY' else 'STATE' end as kind, stem as canonical, count(*) as n from (select doc_id, substr(l, i, 5) as g from places) join (select distinct stem from names) on g = stem group by 1, 3)
select doc_id, kind, canonical, n::int as n from a union all select doc_id, kind, canonical, n::int from b""")
def gazetteer_mentions(spark, d):
    """Names from a table of tens of thousands of terms in whole texts."""
    terms = _terms(spark, d)
    return gazetteer.mentions(table(spark, d, "documents"), "doc_id", F.col("text"), terms).select("doc_id", "kind", "canonical", "n")


@query(f"""with tokens as ({_WORDS}), names as ({_STEMS}), terms as (select w as term, stem from names union select stem, stem from names),
e as (select distinct doc_id, 'ORG' as kind, stem as value from tokens join terms on w = term)
select 'ENT-' || left(sha256(kind || ':' || value), 12) as entity_id, kind, value, count(*)::bigint as documents, min(doc_id) as first_doc from e group by kind, value""")
def gazetteer_entities(spark, d):
    """Each institution of the table with the documents that name it."""
    found = gazetteer.mentions(table(spark, d, "documents"), "doc_id", F.col("text"), _terms(spark, d).where("kind = 'ORG'"))
    return gazetteer.entities(found, "doc_id").groupBy("entity_id", "kind", "value").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


def _hit(needle: str) -> str:
    blob = "b"
    for phrase in geo.HIDES.get(needle, ()):
        blob = f"replace({blob}, '{phrase}', ' ')"
    if geo.edge(needle) is None:
        return f"contains({blob}, '{needle}')"
    return f"regexp_matches({blob}, '(^|[^{geo.LETTERS}]){needle}([^{geo.LETTERS}]|$)')"


_NEEDLES = list(dict.fromkeys([*(w for p in geo.PLACES for w in p[5]), *(a for a, _ in geo.ALIASES)]))
_HEARD = "list_filter([" + ", ".join(f"case when {_hit(n)} then '{n}' end" for n in _NEEDLES) + "], lambda v: v is not null)"
_RANKED = sorted(geo.ALIASES, key=lambda a: -len(a[0]))
_COUNTRY_LIST = "list_filter([" + ", ".join(f"case when list_contains(h, '{a}') then '{c}' end" for a, c in _RANKED) + "], lambda v: v is not null)"
_PLACE_CASE = "case " + " ".join(f"when list_has_any(h, {_sql_list(p[5])}) then '{p[0]}'" for p in geo.PLACES) + " end"
_PLACE_ROWS = "(values " + ", ".join(f"('{p[0]}', '{p[1]}', '{p[2]}', {p[3]}::double, {p[4]}::double, 'place')" for p in geo.PLACES) + ", " + ", ".join(f"('{c}', '{n}', '{c}', {'null' if la is None else la}::double, {'null' if lo is None else lo}::double, 'country')" for c, n, la, lo in geo.COUNTRIES) + ") as t(place_id, name, country, lat, lng, grain)"
STORED = ("MX", "us-tx", "", "ES", "xx", "Texas, EE. UU", "INT", "nowhere")


@query(f"""with a as (select doc_id, ({_sql_list(STORED)})[doc_id % 8 + 1] as stored, title, text from {ARTICLES}), h as (select doc_id, upper(trim(stored)) as raw, {_HEARD} as h from (select *, lower(concat_ws(chr(10), stored, title, text)) as b from a)),
p as (select *, {_PLACE_CASE} as named, {_COUNTRY_LIST} as cs from h),
r as (select *, case when raw in {tuple(p[0] for p in geo.PLACES)} then raw when named is not null then named when raw in {tuple(c[0] for c in geo.COUNTRIES if c[0] not in geo.NOWHERE)} then raw else coalesce(cs[1], 'XX') end as place from p)
select doc_id, (select string_agg(c, '|' order by i) from (select c, min(i) as i from (select unnest(r.cs) as c, unnest(range(len(r.cs))) as i) group by c)) as countries, t.place_id, t.name, t.country, t.lat, t.lng, t.grain, t.lat is null as unlocated
from r join {_PLACE_ROWS} on t.place_id = r.place""")
def places_resolved(spark, d):
    """Where each article belongs on the map, and all countries that its whole text names."""
    a = articles(spark, d).select("doc_id", F.element_at(F.array(*[F.lit(s) for s in STORED]), F.expr("cast(doc_id % 8 as int) + 1")).alias("stored"), "title", "text")
    found = gazetteer.spans(a.select("doc_id", "stored", F.concat_ws("\n", "stored", "title", "text").alias("blob")), F.col("blob"), geo.terms(), keep=["doc_id", "stored"])
    rows = found.select("doc_id", "stored", geo.heard(F.col("found")).alias("h"))
    cs = F.array_join(geo.countries(F.col("h")), "|")
    return rows.select("doc_id", F.when(cs != "", cs).alias("countries"), geo.resolved(F.col("stored"), F.col("h")).alias("p")).select("doc_id", "countries", "p.*")


@query(f"""with a as (select *, ({_sql_list(STORED)})[doc_id % 8 + 1] as stored from {ARTICLES}), h as (select doc_id, title, risk, upper(trim(stored)) as raw, {_HEARD} as h from (select *, lower(concat_ws(chr(10), stored, title, text)) as b from a)),
p as (select *, {_PLACE_CASE} as named, {_COUNTRY_LIST} as cs from h),
r as (select *, case when raw in {tuple(p[0] for p in geo.PLACES)} then raw when named is not null then named when raw in {tuple(c[0] for c in geo.COUNTRIES if c[0] not in geo.NOWHERE)} then raw else coalesce(cs[1], 'XX') end as place from p)
select place as place_id, count(*)::bigint as n, round(avg(risk), 1) as mean_risk, count(*) filter (where risk >= 55)::bigint as alerts, array_to_string(list(doc_id order by doc_id)[1:8], '|') as articles from r group by place""")
def places_map(spark, d):
    """A row of the map for each place: articles, mean risk, alerts and its first eight articles."""
    from marisma.operators.facets import top_per_group

    a = articles(spark, d).select("doc_id", F.element_at(F.array(*[F.lit(s) for s in STORED]), F.expr("cast(doc_id % 8 as int) + 1")).alias("stored"), "title", "text", "risk")
    found = gazetteer.spans(a.select("doc_id", "stored", "risk", F.concat_ws("\n", "stored", "title", "text").alias("blob")), F.col("blob"), geo.terms(), keep=["doc_id", "stored", "risk"])
    rows = found.select("doc_id", "risk", geo.resolved(F.col("stored"), geo.heard(F.col("found")))["place_id"].alias("place_id"))
    first = top_per_group(rows.select("place_id", "doc_id"), ["place_id"], [F.col("doc_id")], 8).groupBy("place_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "|").alias("articles"))
    n = rows.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk"), 1).alias("mean_risk"), F.count_if(F.col("risk") >= 55).alias("alerts"))
    return n.join(first, "place_id")
