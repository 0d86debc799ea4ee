"""Queries of sentences made of fields, and of short forms of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marisma.functions import facts, prose
from marisma.plans.articles import _HOST, _IDS, ARTICLES, _named, articles
from marisma.plans.assessment import _CLAIMS, _claims
from marisma.plans.kit import collapse_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_N = prose.NOTHING
_LIST = "case when len({x}) > 0 then array_to_string({x}, ', ') else '{m}' end"


@query(f"""with a as (select *, {_named('lower(title)', _IDS)} as ds, {_named('lower(text)', facts.ANIMALS)} as an, {_named('lower(text)', facts.PLACES)} as pl, case when contains(lower(text), 'senasica') then ['SENASICA'] else [] end as og from {ARTICLES})
select doc_id, 'Lectura del caso «' || trim(title) || '»: se clasifica como ' || case when trim(verdict) = '' then 'Sin verificar' else trim(verdict) end || ' con ' || case when risk is null then 'riesgo no calculado' else 'riesgo ' || risk || '/100' end || '. Enfermedad: ' || {_LIST.format(x='ds', m=_N['disease'])} || '. Especie: ' || {_LIST.format(x='an', m=_N['animal'])} || '. País o ámbito: ' || {_LIST.format(x='pl', m=_N['country'])}
 || '. Organizaciones de referencia: ' || {_LIST.format(x='og', m=_N['org'])} || '. Fuente: ' || kind || '. El párrafo se arma con entidades, veredicto y riesgo; no decide si el contenido es verdadero.' as reading from a""")
def readings(spark, d):
    """How each article's case is read, of what its whole text names."""
    a, low = articles(spark, d), F.lower("text")
    orgs = F.when(F.contains(low, F.lit("senasica")), F.array(F.lit("SENASICA"))).otherwise(F.array().cast("array<string>"))
    return a.select("doc_id", prose.reading(F.col("title"), F.col("verdict"), F.col("risk"), facts.canonical(F.lower("title"), _IDS), facts.canonical(low, facts.ANIMALS), facts.canonical(low, facts.PLACES), orgs, F.col("kind")).alias("reading"))


@query(f"""with a as (select *, {_named('lower(title)', _IDS)} as ds, list_filter(string_split_regex(trim(title), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: length(w) > 3)[1:6] as own from {ARTICLES})
select doc_id, '«' || trim(title) || '» es un documento de ' || kind || ' sobre ' || {_LIST.format(x='ds', m=_N['disease'])} || '. No había cuerpo periodístico usable: el resumen se reconstruye con el título, la fuente y palabras clave (' || array_to_string(case when len(ds) > 0 then ds[1:6] else own end, ', ') || '). Ámbito geográfico: ' || case when country = '' then 'ámbito no determinado' else country end || '.' as summary from a""")
def summaries(spark, d):
    a = articles(spark, d)
    ds = facts.canonical(F.lower("title"), _IDS)
    return a.select("doc_id", prose.summary(F.col("title"), F.col("kind"), ds, ds, F.col("country")).alias("summary"))


@query(f"""with g as (select doc_id, list_sort(list_distinct(list(case when kind = '' then 'titulo' else kind end))) as kinds, list_sort(list_distinct(list(predicate))) as preds, max(case when kind = 'conspiracion' or predicate in ('OCULTA', 'CAUSA') then 80 when kind in ('brote', 'cifra') then 45 when not verifiable then 35 else 15 end) as v from {_CLAIMS} group by doc_id)
select doc_id, 'Patrón de afirmación: ' || array_to_string(kinds, ', ') || '; predicado ' || array_to_string(preds, ', ') || ' → ' || v || ' (conspiración/oculta=80, brote o cifra=45, no verificable=35, resto=15).' as why from g""")
def severity_told(spark, d):
    """Why the claims of whole articles weigh what they do."""
    from marisma.operators import assessment

    kinds = F.array_sort(F.collect_set(F.when(F.col("kind") == "", "titulo").otherwise(F.col("kind"))))
    rows = _claims(spark, d).groupBy("doc_id").agg(kinds.alias("kinds"), F.array_sort(F.collect_set("predicate")).alias("preds"), assessment.gravest("kind", "predicate", "verifiable").alias("severity"))
    return rows.select("doc_id", prose.severity_part(F.col("kinds"), F.col("preds"), F.col("severity")).alias("why"))


@query(f"""select doc_id, 'NLI de la afirmación: ' || l || '. ' || case l when 'Contradicted' then 'Choca con ficha oficial → 90.' when 'Supported' then 'Cuadra con ficha oficial → 10.' else 'Sin overlap suficiente con ficha oficial → 40 de base.' end || case when coalesce(risk, 0) > 60 then ' Cruce con ' || (doc_id % 5) || ' notas del mismo brote (' || case when kind = 'news' then 'discrepancia' else kind end || ') → ' || risk || '.' else '' end
 || ' Este parámetro toma el máximo de esas vías: ' || greatest(case l when 'Contradicted' then 90 when 'Supported' then 10 else 40 end, case when coalesce(risk, 0) > 60 then risk else 0 end) || '.' as why from (select *, case when nli in ('Supported', 'Contradicted') then nli else 'Unknown' end as l from {ARTICLES})""")
def evidence_told(spark, d):
    a = articles(spark, d)
    label = F.when(F.col("nli").isin("Supported", "Contradicted"), F.col("nli")).otherwise("Unknown")
    cut = F.when(F.coalesce("risk", F.lit(0)) > 60, F.col("risk")).otherwise(0)
    value = F.greatest(F.when(label == "Contradicted", 90).when(label == "Supported", 10).otherwise(40), cut)
    return a.select("doc_id", prose.evidence_part(label, value, cut, F.col("doc_id") % 5, F.when(F.col("kind") != "news", F.col("kind"))).alias("why"))


@query(f"""with a as (select doc_id, {collapse_sql('text')} as raw, {collapse_sql('title')} as t, url, source_id, kind, risk from (select * replace (case when doc_id % 3 = 0 then title || ': ' || text when doc_id % 3 = 1 then '«' || title || '» es un documento de prensa. Nota: site.com 20260101T000000Z ' || text else '' end as text) from {ARTICLES})),
b as (select *, case when t <> '' and starts_with(lower(raw), lower(t)) then regexp_replace(substr(raw, length(t) + 1), '^[ .:;,—-]+', '') else raw end as r1 from a), c as (select *, regexp_replace(r1, '^«[^»]+»\\s*(es un documento[^.]*\\.)?\\s*', '', 'i') as r2 from b),
e as (select *, {collapse_sql("regexp_replace(regexp_replace(regexp_replace(r2, '\\b\\d{8}T\\d+\\S*', ' ', 'g'), '\\b(avian influenza|h5n1|hpai|screwworm|senasica|woah|classical swine fever|gusano barrenador|gripe aviar)\\b', ' ', 'gi'), '\\b[\\w.-]+\\.(com|org|net|gov|edu|mx)\\b', ' ', 'gi')")} as r3 from c)
select doc_id, case when length(r3) < 48 or lower(r3) = lower(t) then '' when length(r3) > 180 then substr(r3, 1, 179) || '…' else r3 end as excerpt, case when risk >= 70 then 'high' when risk >= 40 or risk is null then 'mid' else 'low' end as tone,
 case when doc_id % 4 = 0 then case when {_HOST} <> '' and not contains({_HOST}, 'gdeltproject.org') then {_HOST} end when doc_id % 4 = 1 then 'Diario' when doc_id % 4 = 2 then kind else 'SRC-9' end as shown from e""")
def cards_shown(spark, d):
    """The excerpt, the tone and the source's name on the card of each article."""
    a, n = articles(spark, d), F.col("doc_id")
    body = F.when(n % 3 == 0, F.concat_ws(": ", "title", "text")).when(n % 3 == 1, F.concat(F.lit("«"), "title", F.lit("» es un documento de prensa. Nota: site.com 20260101T000000Z "), "text")).otherwise("")
    shown = prose.source_name(F.when(n % 4 == 0, F.col("url")).otherwise(""), F.when(n % 4 == 1, "Diario").when(n % 4 == 3, "SRC-9"), F.when(n % 4 == 2, F.col("kind")).otherwise("src-1"), F.col("source_id"))
    return a.select("doc_id", prose.card_excerpt(body, F.col("title")).alias("excerpt"), prose.risk_tone(F.col("risk")).alias("tone"), shown.alias("shown"))


_WORDS = "case " + " ".join(f"when contains(lower(title || ' ' || text), '{w}') then '{c}'" for w, c in prose.COUNTRY_WORDS) + " else 'INT' end"


@query(f"""with a as (select doc_id, {_WORDS} as country, {_named('lower(title)', _IDS)} as ds, {_named('lower(title)', facts.PLACES)} as ps, regexp_extract(case when doc_id % 3 = 0 then '' else url end, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as h, raw_format from {ARTICLES})
select doc_id, country, 'SRC-' || upper(left(trim(regexp_replace(replace(lower(coalesce(nullif(h, ''), raw_format)), 'www.', ''), '[^a-z0-9]+', '-', 'g'), '-'), 28)) as source_id,
 array_to_string(['"' || coalesce(ds[1], 'animal disease outbreak') || '" site:woah.org OR site:who.int OR site:cdc.gov OR site:fao.org', '"' || coalesce(ds[1], 'animal disease outbreak') || '" ' || coalesce(ps[1], '') || ' official report', '"' || coalesce(ds[1], 'animal disease outbreak') || '" SENASICA OR WAHIS outbreak', '"' || coalesce(ds[1], 'animal disease outbreak') || '" fact check'], ' | ') as searches from a""")
def import_fields(spark, d):
    """Country and source of imported articles, and what to look for to check them."""
    a = articles(spark, d)
    low = F.lower("title")
    url = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("url"))
    return a.select("doc_id", prose.country_from_text(F.concat_ws(" ", "title", "text")).alias("country"), prose.source_id_for(url, F.col("raw_format")).alias("source_id"), F.array_join(prose.search_queries(facts.canonical(low, _IDS), facts.canonical(low, facts.PLACES)), " | ").alias("searches"))
