"""Queries of the rules that judge articles, sources, addresses and pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.functions import facts, pictures, scoring, text, urls
from marisma.operators import assessment, cards, facets, reviews, stories
from marisma.plans import articles as base
from marisma.plans.articles import _HOST, _IDS, ARTICLES, _both, _compare, _facts, _named, _paragraphs, _pick, _sql_list, _tokens, articles
from marisma.plans.texts import _modality_sql
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CLAIMS = f"({base.SQL['claim_patterns']})"


def _claims(spark, d):
    """Claims of whole articles, with a label from the length of their subject."""
    c = reviews.claims(articles(spark, d), "doc_id", F.col("text"), facts.canonical(F.lower("text"), _IDS), base.ORGS, base.COUNTRY_NAMES, base.ANIMAL_NAMES)
    return c.withColumn("label", _pick(base.LABELS, "length(subject) % 4"))


_LABELLED = f"(select *, ({_sql_list(base.LABELS)})[length(subject) % 4 + 1] as label from {_CLAIMS})"
_SEVERITY = f"select doc_id, max(case when kind = 'conspiracion' or predicate in ('OCULTA', 'CAUSA') then 80 when kind in ('brote', 'cifra') then 45 when not verifiable then 35 else 15 end) as severity from {_CLAIMS} group by doc_id"


@query(_SEVERITY)
def claim_severity(spark, d):
    return assessment.severity(_claims(spark, d), "doc_id", "kind", "predicate", "verifiable")


_ARTICLE_LABEL = f"select doc_id, (count(*) filter (where label = 'Supported'))::bigint as supported, (count(*) filter (where label = 'Contradicted'))::bigint as contradicted, count(*)::bigint as claims, case when count(*) filter (where label = 'Contradicted') > count(*) filter (where label = 'Supported') then 'Contradicted' when count(*) filter (where label = 'Supported') > 0 then 'Supported' else 'Unknown' end as label from {_LABELLED} group by doc_id"


@query(_ARTICLE_LABEL)
def article_label(spark, d):
    return assessment.labels(_claims(spark, d), "doc_id", "label")


_ONE_STANCE = "(select case when label in ('Supported', 'Contradicted') then label else 'Unknown' end as stance, doc_id from {c})".format(c=_LABELLED)


@query(" union all ".join(f"select '{name}' as among, s.stance, (select count(*) from {_ONE_STANCE} x where x.stance = s.stance and {test})::bigint as n from (values ('Supported'), ('Contradicted'), ('Unknown')) s(stance)" for name, test in (("all", "true"), ("some", "doc_id in (select doc_id from labels where quality = 1)"), ("none", "true"))))
def stance_counts(spark, d):
    """Stances of the claims of all articles, of those in a set, and of an empty set, which filters nothing."""
    c, some = _claims(spark, d), table(spark, d, "labels").where("quality = 1").select("doc_id")
    named = lambda name, ids: assessment.stances(c, "doc_id", "label", ids).withColumn("among", F.lit(name))
    return named("all", None).union(named("some", some)).union(named("none", some.limit(0))).select("among", "stance", "n")


_OFFICIAL = "upper(kind) = 'OFFICIAL' or (kind = 'social' and doc_id % 4 = 0)"


@query(f"""with p as ({base.SQL['peer_rows']}), s as ({_SEVERITY}), l as ({_ARTICLE_LABEL}), o as (select doc_id, upper(verdict) as verdict, {_OFFICIAL} as official from {ARTICLES}),
n as (select anchor, count(*) filter (where verdict = 'RESPALDADO' and official) as ok, count(*) filter (where verdict = 'RESPALDADO') as backed, count(*) filter (where verdict = 'CONTRADICHO') as against from p join o on peer = doc_id group by anchor),
a as (select o.doc_id, coalesce(l.label, 'Unknown') as nli, coalesce(s.severity, 0) as severity, o.official, coalesce(n.ok, 0) as ok, coalesce(n.backed, 0) as backed, coalesce(n.against, 0) as against from o left join n on anchor = o.doc_id left join s on s.doc_id = o.doc_id left join l on l.doc_id = o.doc_id where o.doc_id % 20 = 0)
select doc_id, case when ok > 0 and not official and (nli = 'Contradicted' or severity >= 80) then 88.0 when ok > 0 and not official and nli = 'Unknown' then 58.0 when backed > 0 and against > 0 then 72.0 else 0.0 end::double as score,
 case when ok > 0 and not official and (nli = 'Contradicted' or severity >= 80) then 'discrepa_oficial' when ok > 0 and not official and nli = 'Unknown' then 'no_cuadra_oficial' when backed > 0 and against > 0 then 'fuentes_parten' else '' end as reason,
 (case when ok > 0 and not official and (nli = 'Contradicted' or severity >= 80 or nli = 'Unknown') then ok when backed > 0 and against > 0 then backed + against else 0 end)::bigint as peers from a""")
def cross_cut_score(spark, d):
    """Whether the peers of an article and official ones among them say the same of it."""
    a = articles(spark, d)
    grade = F.when((F.col("kind") == "social") & (F.col("doc_id") % 4 == 0), "A").otherwise("C")
    o = a.select("doc_id", F.upper("verdict").alias("verdict"), assessment.official_row(F.col("kind"), F.lit(""), assessment.unreliability(grade, F.lit(""), F.lit(""), F.lit(""), F.lit(0))).alias("official"))
    near = base.near(spark, d)
    peers = stories.peers(near.where("doc_id % 20 = 0"), near, "doc_id", "country", "tags", "day").join(o.withColumnRenamed("doc_id", "peer"), "peer").select(F.col("anchor").alias("doc_id"), "verdict", "official")
    c = _claims(spark, d)
    rows = o.where("doc_id % 20 = 0").join(assessment.severity(c, "doc_id", "kind", "predicate", "verifiable"), "doc_id", "left").join(assessment.labels(c, "doc_id", "label").select("doc_id", F.col("label").alias("nli")), "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce("nli", F.lit("Unknown")).alias("nli"), F.coalesce("severity", F.lit(0)).alias("severity"), "official")
    return assessment.cross_cut(rows, "doc_id", peers)


_KINDS = ("OFFICIAL_NATIONAL", "research", "General_Media", "forum", "blog", "RESEARCH_LAB")
_CATS = ("official", "veterinary", "media", "other")
_PAGE = f"(select page_id, case when page_id % 9 = 0 then 'woah.org' when page_id % 9 = 1 then '.aphis.usda.gov' else {_HOST} end as domain, case page_id % 6 when 0 then ' d ' when 1 then 'X' end as stated, ({_sql_list(_KINDS)})[page_id % 6 + 1] as kind, ({_sql_list(_CATS)})[page_id // 2 % 4 + 1] as category, case when page_id % 5 = 0 then 'api' end as access, page_id % 31 - 15 as shift from pages)"
_GRADE = "coalesce(case when upper(trim(stated)) in ('A', 'B', 'C', 'D', 'E', 'F') then upper(trim(stated)) end, case when regexp_matches(ltrim(domain, '.'), '(^|\\.)(woah\\.org|usda\\.gov)$') then 'A' end, case upper(kind) when 'OFFICIAL_NATIONAL' then 'A' when 'RESEARCH' then 'B' when 'GENERAL_MEDIA' then 'C' when 'FORUM' then 'E' end, case category when 'official' then 'A' when 'veterinary' then 'B' when 'media' then 'C' end, '')"


@query(f"""with p as (select *, {_GRADE} as authority from {_PAGE}), u as (select *, least(100.0, greatest(0.0, case authority when 'A' then 10 when 'B' then 25 when 'C' then 45 when 'D' then 60 when 'E' then 75 when 'F' then 90 else case when upper(kind) = 'OFFICIAL_NATIONAL' or category = 'official' then 12 when contains(upper(kind), 'RESEARCH') or category = 'research' then 20 when access = 'api' then 40 else 55 end end + shift))::double as unreliability from p)
select page_id, authority, unreliability, upper(kind) = 'OFFICIAL_NATIONAL' or category = 'official' or unreliability <= 20 as official_row, regexp_matches(lower(concat_ws(' ', domain, kind, category)), 'woah\\.org|wahis|who\\.int|paho\\.org|fao\\.org|cdc\\.gov|efsa\\.europa|gob\\.mx|senasica|usda\\.gov|aphis|oie\\.int|oficial') as official_evidence,
 regexp_matches(lower(concat_ws(' ', kind, category, domain)), 'official|gob\\.mx|usda|woah|aphis|senasica|tahc|who\\.int|cdc\\.gov') as official_source from u""")
def source_grades(spark, d):
    """How far the hosts of pages can be relied on, and the three ways in which a source is official."""
    n = F.col("page_id")
    p = table(spark, d, "pages").select(
        "page_id", "url", F.when(n % 9 == 0, "woah.org").when(n % 9 == 1, ".aphis.usda.gov").otherwise(urls.host(F.col("url"))).alias("domain"), F.when(n % 6 == 0, " d ").when(n % 6 == 1, "X").alias("stated"),
        _pick(_KINDS, "page_id % 6").alias("kind"), _pick(_CATS, "page_id div 2 % 4").alias("category"), F.when(n % 5 == 0, "api").alias("access"), (n % 31 - 15).alias("shift"),
    )
    p = p.withColumn("authority", assessment.authority(F.col("stated"), F.col("domain"), F.col("kind"), F.col("category")))
    p = p.withColumn("unreliability", assessment.unreliability(F.col("authority"), F.col("kind"), F.col("category"), F.col("access"), F.col("shift")))
    k, c, h = F.col("kind"), F.col("category"), F.col("domain")
    return p.select("page_id", "authority", "unreliability", assessment.official_row(k, c, F.col("unreliability")).alias("official_row"), assessment.official_evidence(h, k, F.lit(""), c).alias("official_evidence"), assessment.official_source(F.col("url"), k, c, h).alias("official_source"))


_VARIED = "case page_id % 10 when 0 then 'http://localhost:80/x' when 1 then 'inapp:' || page_id when 2 then 'https://User@www.GOB.mx:443/a' when 3 then 'ftp://who.int/a' when 4 then 'https://x.example.invalid./a' when 5 then ' ' || replace(url, 'example.', 'exemplar.') || ' ' when 6 then '' when 7 then 'https://news.site/rumor-vacuna' else url end"
_HOSTNAME = "rtrim(lower(regexp_extract(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.')"
_FAKE = f"(trim(u) <> '' and (regexp_matches(lower(u), 'example\\.invalid|example\\.com|social\\.local|rumor-vacuna|rumor vacuna') or host in {pictures.BLOCKED} or ends_with(host, '.example.com') or ends_with(host, '.example.invalid')))"
_ALLOWED = "(host not in " + str(pictures.BLOCKED) + " and (" + " or ".join(f"host = '{a}' or ends_with(host, '.{a}')" for a in pictures.ALLOWED) + "))"


@query(f"""with v as (select page_id, coalesce({_VARIED}, '') as u from pages), h as (select *, {_HOSTNAME} as host, regexp_matches(lower(trim(u)), '^https?://') as web from v), f as (select *, {_FAKE} as fake, {_ALLOWED} as allowed from h)
select page_id, host, fake, allowed, case when not fake and web and allowed then trim(u) else '' end as public, case when fake then '' when starts_with(trim(u), 'inapp:') or (web and host <> '' and host not in {pictures.BLOCKED}) then trim(u) else '' end as stored from f""")
def url_safety(spark, d):
    """Which addresses of pages are made up, trusted, shown and stored."""
    n = F.col("page_id") % 10
    u = F.when(n == 0, "http://localhost:80/x").when(n == 1, F.concat(F.lit("inapp:"), F.col("page_id").cast("string"))).when(n == 2, "https://User@www.GOB.mx:443/a").when(n == 3, "ftp://who.int/a").when(n == 4, "https://x.example.invalid./a")
    u = u.when(n == 5, F.concat(F.lit(" "), F.replace("url", F.lit("example."), F.lit("exemplar.")), F.lit(" "))).when(n == 6, "").when(n == 7, "https://news.site/rumor-vacuna").otherwise(F.col("url"))
    host = pictures.hostname(u)
    return table(spark, d, "pages").select("page_id", host.alias("host"), pictures.is_fake(u).alias("fake"), pictures.host_allowed(host).alias("allowed"), pictures.public_url(u).alias("public"), pictures.stored_url(u).alias("stored"))


_PLACE = "case page_id % 8 when 0 then 'img\\Ph_' || page_id || '.png' when 1 then '/data/models/cnn/' || page_id || '.jpg' when 2 then 'fb_' || page_id || '.jpg' when 3 then 'a/demo_seed_1.webp' when 4 then '' when 5 then 'p/photo' || page_id || '.SVG' when 6 then 'p/photo' || page_id || '.tiff' else 'p/q/photo' || page_id || '.JPG' end"
_SOURCE = "case page_id % 3 when 0 then url when 1 then 'inapp:x' else '' end"
_MIME = "case page_id % 5 when 0 then 'image/jpeg' when 1 then 'image/svg+xml' when 2 then 'image/gif' else '' end"
_PICTURES = f"(select *, lower(replace(place, '\\', '/')) as k, lower(replace(src, '\\', '/')) as s, regexp_extract(lower(replace(place, '\\', '/')), '([^/]*)/*$', 1) as name, regexp_extract(lower(src), '([^/]*)/*$', 1) as other from (select page_id, sha256(url) as digest, {_PLACE} as place, coalesce({_SOURCE}, '') as src, {_MIME} as mime, ({_sql_list(pictures.CLASSES)})[page_id % 8 + 1] as class, (page_id % 100) / 100.0 as conf, page_id % 29 = 0 as synthetic, (page_id % 140)::int as w from pages))"


def _images(spark, d):
    n = F.col("page_id")
    number = n.cast("string")
    named = lambda a, b="": F.concat(F.lit(a), number, F.lit(b))
    m = n % 8
    place = F.when(m == 0, named("img\\Ph_", ".png")).when(m == 1, named("/data/models/cnn/", ".jpg")).when(m == 2, named("fb_", ".jpg")).when(m == 3, "a/demo_seed_1.webp").when(m == 4, "").when(m == 5, named("p/photo", ".SVG")).when(m == 6, named("p/photo", ".tiff")).otherwise(named("p/q/photo", ".JPG"))
    return table(spark, d, "pages").select(
        "page_id", F.sha2("url", 256).alias("digest"), place.alias("storage_key"), F.when(n % 3 == 0, F.col("url")).when(n % 3 == 1, "inapp:x").otherwise("").alias("source_url"), F.when(n % 5 == 0, "image/jpeg").when(n % 5 == 1, "image/svg+xml").when(n % 5 == 2, "image/gif").otherwise("").alias("mime"),
        _pick(pictures.CLASSES, "page_id % 8").alias("class"), (n % 100 / 100).alias("confidence"), (n % 29 == 0).alias("synthetic"), (n % 140).cast("int").alias("width"), (n % 140).cast("int").alias("height"),
    )


_PLACEHOLDER = "(regexp_matches(concat_ws(' ', name, k, s), 'fb_|demo_seed_|ph_|corpus_|casos|cnn/dataset|models/cnn|cnn_synth|inapp:') or synthetic or starts_with(lower(trim(src)), 'data:') or not regexp_matches(lower(trim(src)), '^https?://') or (w > 0 and w <= 64))"


@query(f"""select page_id, case when starts_with(name, 'ph_') or ends_with(name, '.svg') or contains(mime, 'svg') then false when regexp_matches(k || ' ' || s, 'models/cnn|cnn/dataset') then false
 when starts_with(name || ' ' || other, 'corpus_') or contains(name || ' ' || other, ' corpus_') or starts_with(name || ' ' || other, 'fb_') or contains(name || ' ' || other, ' fb_') or contains(name || ' ' || other, 'demo_seed_') then false when mime <> '' and not regexp_matches(mime, 'jpeg|jpg|png|webp|svg') then false else regexp_matches(s, '^https?://') or place <> '' end as news,
 trim(place) = '' or starts_with(name, 'ph_') or ends_with(name, '.svg') or regexp_matches(k || ' ' || mime, 'image/svg|models/cnn|cnn/dataset|/fb_|/corpus_|demo_seed') or starts_with(name, 'fb_') or starts_with(name, 'corpus_') as generic, {_PLACEHOLDER} as placeholder from {_PICTURES}""")
def picture_rules(spark, d):
    """Which pictures are news, which are nothing to show, which are not to be learned from."""
    p, c = _images(spark, d), F.col
    return p.select("page_id", pictures.is_news_picture(c("page_id").cast("string"), c("storage_key"), c("source_url"), c("mime")).alias("news"), pictures.is_generic(c("storage_key"), c("mime")).alias("generic"), pictures.is_placeholder(c("storage_key"), c("source_url"), c("synthetic"), c("width"), c("height")).alias("placeholder"))


@query(f"""with g as (select *, case when page_id % 7 > 0 then left(digest, 2) end as sha from (select page_id, sha256(url) as digest, 'p/q/photo' || page_id || '.JPG' as place, 'p/q/photo' || page_id || '.jpg' as k, 'photo' || page_id || '.jpg' as name, url as src, lower(url) as s, ({_sql_list(pictures.CLASSES)})[page_id % 8 + 1] as class, (page_id % 100) / 100.0 as conf, page_id % 29 = 0 as synthetic, (page_id % 140)::int as w from pages)),
k as (select * from g where conf >= 0.5 and not {_PLACEHOLDER}), f as (select * from (select *, row_number() over (partition by coalesce(sha, 'none' || page_id) order by page_id) as turn from k where sha is null or sha not in ('0a', '1b', '2c', '3d')) where turn = 1),
n as (select *, coalesce(sha, 'photo' || page_id) || '.jpg' as file from f), x as (select *, coalesce(sha, sha256(file)) as dig from n)
select 'CNN-' || left(sha256(class || ':' || file), 16) as sample_id, page_id, class, class || '/' || file as path, case when ('0x' || left(dig, 8))::bigint % 100 < 70 then 'train' when ('0x' || left(dig, 8))::bigint % 100 < 85 then 'val' else 'test' end as split, conf::double as confidence from x""")
def samples_exported(spark, d):
    """Pictures that go to the training set: one for each digest that it doesn't have."""
    n = F.col("page_id")
    p = _images(spark, d).drop("storage_key", "source_url").join(table(spark, d, "pages").select("page_id", F.col("url").alias("source_url")), "page_id").withColumn("storage_key", F.concat(F.lit("p/q/photo"), n.cast("string"), F.lit(".JPG")))
    p = p.withColumn("image_id", n).withColumn("sha256", F.when(n % 7 > 0, F.substring("digest", 1, 2)))
    known = spark.createDataFrame([("0a",), ("1b",), ("2c",), ("3d",)], "sha256 string")
    return assessment.exported(p, "page_id", known).select("sample_id", F.col("image_id").alias("page_id"), "class", "path", "split", "confidence")


@query(f"""with l as ({_ARTICLE_LABEL}), a as (select doc_id, case doc_id % 3 when 0 then '' when 1 then 'x' end as reading, case doc_id % 5 when 0 then 'local' when 1 then 'own' end as provider, snippet, risk from {ARTICLES}),
j as (select a.*, coalesce(claims, 0) as claims, coalesce(supported + contradicted, 0) as judged, reading = 'x' and coalesce(provider, '') not in ('', 'local') as used from a left join l using (doc_id)),
s as (select *, least(100, 18 + 18 * (claims > 0)::int + 18 * (judged > 0)::int + 16 * (length(snippet) >= 85)::int + 12 * (coalesce(risk, 0) > 50)::int + 18 * coalesce(used, false)::int) as score from j)
select doc_id, score, case when score >= 70 then 'alta' when score >= 45 then 'media' else 'baja' end as band, coalesce(used, false) as llm_used from s""")
def explanation_quality(spark, d):
    """How well articles are explained: by their claims, stances, evidence, pictures and reading."""
    l = assessment.labels(_claims(spark, d), "doc_id", "label").select("doc_id", "claims", (F.col("supported") + F.col("contradicted")).alias("judged"))  # noqa: E741
    a = articles(spark, d).select("doc_id", "snippet", "risk").join(l, "doc_id", "left").fillna(0, ["claims", "judged"])
    reading, provider = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "x"), F.when(F.col("doc_id") % 5 == 0, "local").when(F.col("doc_id") % 5 == 1, "own")
    e = assessment.explanation(F.col("claims"), F.col("judged"), F.when(F.length("snippet") >= 85, 1).otherwise(0), F.when(F.coalesce("risk", F.lit(0)) > 50, 1).otherwise(0), reading, provider)
    return a.select("doc_id", e.alias("e")).select("doc_id", "e.*")


_DISEASE_NAMES = list(_IDS)
_WORK_KINDS = f"list_filter([case when len({_named('lower(text)', facts.ANIMALS)}) > 0 then 'animal' end, case when regexp_matches(lower(text), 'senasica|woah|aphis') then 'ORG' end, case when len({_named('lower(text)', facts.PLACES)}) > 0 then 'LOCATION' end], lambda v: v is not null)"


@query(f"""with a as (select doc_id, title, text, {_WORK_KINDS} as kinds, list_transform({_named('lower(title)', _IDS)}, lambda v: 'https://official/' || v) as expected, case doc_id % 3 when 0 then ['https://official/gripe_aviar', 'https://other/'] when 1 then list_transform({_named('lower(title)', _IDS)}, lambda v: 'https://official/' || v) else [] end as stored,
 case when doc_id % 11 <> 0 then 'ficha_v2' end as version, doc_id % 13 <> 0 as pictured, case when doc_id % 7 = 0 then 'Análisis local: solapamiento con la ficha, que se explica con bastante detalle en este texto para que sea largo' when doc_id % 7 = 1 then 'corto' else text end as reading, {_sql_list([f'https://official/{i}' for i in _DISEASE_NAMES])} as known from {ARTICLES})
select doc_id, coalesce(version, '') <> 'ficha_v2' or trim(text) = '' or trim(text) = trim(title) or length(trim(text)) < 50 or not list_contains(list_transform(kinds, lambda k: upper(k)), 'ANIMAL') or not list_contains(kinds, 'ORG') or not list_contains(kinds, 'LOCATION')
 or len(list_filter(stored, lambda v: list_contains(known, v) and not list_contains(expected, v))) > 0 or (len(expected) > 0 and len(list_filter(stored, lambda v: list_contains(expected, v))) < least(2, len(expected))) or not pictured or length(trim(reading)) < 80 or contains(lower(reading), 'solapamiento') as needs from a""")
def enrichment_needed(spark, d):
    """Which articles have to be completed: eight checks of text, entities, evidence, picture and reading."""
    a, n, low = articles(spark, d), F.col("doc_id"), F.lower("text")
    own = F.transform(facts.canonical(F.lower("title"), _IDS), lambda v: F.concat(F.lit("https://official/"), v))
    kinds = F.array_compact(F.array(F.when(F.size(facts.canonical(low, facts.ANIMALS)) > 0, "animal"), F.when(low.rlike("senasica|woah|aphis"), "ORG"), F.when(F.size(facts.canonical(low, facts.PLACES)) > 0, "LOCATION")))
    stored = F.when(n % 3 == 0, F.array(F.lit("https://official/gripe_aviar"), F.lit("https://other/"))).when(n % 3 == 1, own).otherwise(F.array().cast("array<string>"))
    reading = F.when(n % 7 == 0, "Análisis local: solapamiento con la ficha, que se explica con bastante detalle en este texto para que sea largo").when(n % 7 == 1, "corto").otherwise(F.col("text"))
    known = F.array(*[F.lit(f"https://official/{i}") for i in _DISEASE_NAMES])
    return a.select("doc_id", assessment.needs_work(F.when(n % 11 != 0, "ficha_v2"), F.col("title"), F.col("text"), kinds, stored, own, known, n % 13 != 0, reading).alias("needs"))




@query(f"""select conv_id, turn, other::bigint as other, case when share >= 0.2 then 'supports' else 'insufficient' end as verdict, round(case when share >= 0.2 then least(0.72::double, share * 0.55::double + 0.32::double) else greatest(0.12::double, share * 0.6::double) end, 3) as confidence from (
 select conv_id, 0 as turn, arg_max(o, (share, -o)) as other, max(share) as share from (select a.conv_id, b.turn as o, case when len(list_filter(a.t, lambda x: length(x) >= 5)) = 0 then 0.0::double else len(list_intersect(list_filter(a.t, lambda x: length(x) >= 5), list_filter(b.t, lambda x: length(x) >= 5)))::double / len(list_filter(a.t, lambda x: length(x) >= 5)) end as share
  from (select conv_id, {_tokens('text')} as t from conversations where turn = 0) a join (select conv_id, turn, {_tokens('text')} as t from conversations where turn > 0) b using (conv_id)) group by conv_id)""")
def overlap_verdict(spark, d):
    """The turn that has most words of a conversation's first one, and what that is worth as support."""
    c = table(spark, d, "conversations").select("conv_id", "turn", text.tokens(F.coalesce("text", F.lit("")), facts.STOP).alias("t"))
    j = c.where("turn > 0").join(c.where("turn = 0").select("conv_id", F.col("t").alias("own")), "conv_id")
    best = j.groupBy("conv_id").agg(F.max(F.struct(text.overlap_share(F.col("own"), F.col("t")).alias("share"), (-F.col("turn")).alias("m"))).alias("b"))
    return best.select("conv_id", F.lit(0).alias("turn"), (-F.col("b.m")).alias("other"), assessment.overlap(F.col("b.share")).alias("v")).select("conv_id", "turn", "other", "v.*")


@query(f"""with t as (select doc_id, kind in ('official', 'social') as official, len({_tokens('title')}) as n, len({_both(_tokens('title'), _tokens('text'))}) as o, len({_both(_both(_tokens('title'), _tokens('text')), _sql_list(facts.ANCHORS))}) as k from {ARTICLES})
select doc_id, array_to_string(list_filter([case when not official then 'la URL no es dominio oficial' end, case when n < 5 then 'la afirmación tiene ' || n || ' tokens (mínimo 5)' end, case when o < 6 then 'coinciden ' || o || ' palabras con la ficha (mínimo 6)' end,
 case when k < 2 then 'anclas de enfermedad: ' || k || ' (mínimo 2: h5n1, barrenador, senasica…)' end, case when o - k < 2 then 'la ficha nombra la enfermedad, pero no el hecho de la nota (lugar, animal, caso concreto)' end], lambda v: v is not null), '; ') as missing from t""")
def evidence_missing(spark, d):
    """What keeps a whole article from supporting its headline."""
    a = articles(spark, d).select("doc_id", F.col("kind").isin("official", "social").alias("official"), text.tokens(F.col("title"), facts.STOP).alias("own"), text.tokens(F.col("text"), facts.STOP).alias("other"))
    a = text.once(a, shared=F.array_intersect("own", "other"))
    held = F.size(F.array_intersect("shared", F.array(*[F.lit(x) for x in facts.ANCHORS])))
    return a.select("doc_id", F.array_join(assessment.missing(F.col("official"), F.size("own"), F.size("shared"), held), "; ").alias("missing"))


@query(f"""with t as (select doc_id, title, text, {_named('lower(title)', _IDS)} as tags from {ARTICLES}), g as (select doc_id as page, text as body, tag, row_number() over (partition by tag order by doc_id) as r from (select *, unnest(tags) as tag from t where doc_id % 20 <> 0)), pages_of as (select * from g where r <= 5),
pairs as (select distinct t.doc_id, t.title as claim, p.page, p.body from (select *, unnest(tags) as tag from t where doc_id % 20 = 0) t join pages_of p on p.tag = t.tag), best as (select * from {_paragraphs('pairs', 'doc_id, page', 'claim', 'body')}),
u as (select pairs.*, coalesce(best.paragraph, substr(trim(body), 1, 500)) as snippet, coalesce(best.score, 0) as points from pairs left join best using (doc_id, page)), c as (select *, {_compare('x', 'y')} as c from (select *, {_facts('claim')} as x, {_facts('snippet')} as y from u)),
s as (select doc_id, page, snippet, c.status as status, (points + case c.status when 'hit' then 5 when 'partial' then 2 else 0 end)::int as score from c where c.status in ('hit', 'partial') or points >= 3)
select doc_id, page, sha256(substr(snippet, 1, 900)) as snippet_sha256, status, score, turn::int as turn from (select *, row_number() over (partition by doc_id order by score desc, page) as turn from s) where turn <= 4""")
def event_cards(spark, d):
    """The best passages of the bulletins that a headline's diseases name."""
    a = articles(spark, d).select("doc_id", "title", "text", facts.canonical(F.lower("title"), _IDS).alias("tags"))
    listed = a.where("doc_id % 20 <> 0").select(F.col("doc_id").alias("page"), F.col("text").alias("body"), F.explode("tags").alias("tag"))
    few = facets.top_per_group(listed, ["tag"], [F.col("page")], 5).drop("turn")
    pairs = a.where("doc_id % 20 = 0").select("doc_id", F.col("title").alias("claim"), F.explode("tags").alias("tag")).join(few, "tag").drop("tag").dropDuplicates(["doc_id", "page"])
    return assessment.event_cards(pairs, "doc_id", "page", "claim", "body", ["page"]).select("doc_id", "page", F.sha2("snippet", 256).alias("snippet_sha256"), "status", "score", "turn")


@query(f"""with p as (select page_id, sha256(url) as h, sha256(html) as g from pages) select page_id, list_sum([case when h[i:i] <> g[i:i] then 1 else 0 end for i in range(1, 65)])::int as digits from p""")
def hex_digits_apart(spark, d):
    return table(spark, d, "pages").select("page_id", pictures.hex_distance(F.sha2("url", 256), F.sha2("html", 256)).alias("digits"))


_WHY = "case code " + " ".join(f"when '{k}' then '{v}'" for k, v in cards.WHY.items()) + " end"


@query(f"""with c as (select * from {_LABELLED}), g as (select doc_id, list({{turn: turn, claim_id: claim_id, low: lower(label)}} order by turn) as cs from c group by doc_id),
j as (select a.doc_id, a.title, a.text, coalesce(cs, []) as cs, contains(lower(a.text), 'siglo')::int as structures, contains(lower(a.text), 'ocult') as hidden from {ARTICLES} a left join g using (doc_id)),
k as (select *, list_transform(cs, lambda c: case when contains(c.low, 'contrad') then 'contradicha' when regexp_matches(c.low, 'support|respald') then 'respaldada' else 'no_verificable' end) as k from j),
o as (select *, len(list_filter(k, lambda v: v = 'contradicha')) as against from k),
p as (select *, case when against > 0 and against >= greatest(1, len(k) // 2) then 'contradicha' when list_contains(k, 'respaldada') and against = 0 and structures = 0 then case when len(list_distinct(k)) > 1 then 'parcial' else 'respaldada' end when hidden and structures >= 1 and not list_contains(k, 'respaldada') then 'prioridad_investigacion' else 'no_verificable' end as code from o)
select doc_id, array_to_string(list_transform(list_filter(cs, lambda c: contains(c.low, 'contrad'))[1:5], lambda c: c.claim_id), ',') as contradicted, array_to_string(list_transform(list_filter(cs, lambda c: c.low in ('', 'unknown'))[1:5], lambda c: c.claim_id), ',') as open,
 case when regexp_matches(lower(title || ' ' || text), 'oblig|plazo') then '{cards.DUTY}' end as duty, code, {_WHY} as why from p""")
def contrast_cards(spark, d):
    """What articles claim beside what is known of it, and the state that makes."""
    a, low = articles(spark, d), F.lower("text")
    out = cards.contrast(a, "doc_id", _claims(spark, d), F.contains(low, F.lit("siglo")).cast("int"), F.contains(low, F.lit("ocult")))
    return out.select("doc_id", F.array_join("contradicted", ",").alias("contradicted"), F.array_join("open", ",").alias("open"), "duty", "code", "why")


_MODE = _modality_sql("s")
_NOTE = "case when not hidden then case when mode = 'pregunta' then '" + assessment.QUESTION + "' else '" + assessment.PRINCIPLE + "' end " + " ".join(f"when mode = '{k}' then '{v}'" for k, v in assessment.NOTES.items()) + " else '" + assessment.HIDING + "' end"


@query(f"""with s as (select doc_id, unnest(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]'), lambda v: trim(v))) as s from {ARTICLES}), m as (select doc_id, contains(lower(s), 'ocult') as hidden, {_MODE} as mode from s where s <> '')
select note, count(*)::bigint as sentences, count(distinct doc_id)::bigint as documents from (select *, {_NOTE} as note from m) group by note""")
def context_notes(spark, d):
    """What to keep in mind of the sentences of whole articles."""
    s = articles(spark, d).select("doc_id", F.explode(text.ended(F.col("text"))).alias("s")).where("s <> ''")
    rows = text.once(s, mode=text.modality(F.col("s")), hidden=F.contains(F.lower("s"), F.lit("ocult")))
    notes = rows.groupBy("doc_id", assessment.note(F.col("mode"), F.col("hidden")).alias("note")).agg(F.count(F.lit(1)).alias("n"))
    return notes.groupBy("note").agg(F.sum("n").alias("sentences"), F.count(F.lit(1)).alias("documents"))
