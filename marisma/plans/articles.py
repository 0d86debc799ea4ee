"""Queries over articles: facts, claims, stance, contrast, relevance, listings, charts, places, narratives.

The tables hold invented prose, so articles are the documents with the beginning of a headline, some sentences and an address added; which ones is told by the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.functions import facts, text, urls
from marisma.operators import articles as listing
from marisma.operators import filters, relevance, reviews, stories
from marisma.plans.kit import collapse_sql
from marisma.session import shared_checkpoints
from marisma.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TITLES = (
    "Confirman primer caso de gusano barrenador en un caballo de Presidio, Texas",
    "Gripe aviar H5N1 en aves de corral: SENASICA refuerza la bioseguridad en Chiapas",
    "Autoridades ocultan el brote de influenza aviar en Oaxaca, dicen usuarios",
    "Vacunas causan la peste porcina, afirman mensajes sin pruebas",
    "First case of new world screwworm in a dog reported in New Mexico",
    "El precio del maíz sube en los mercados del norte del país",
    "WOAH informa de casos confirmados de gripe aviar en ganado bovino de Estados Unidos",
    "Miasis en venado y fauna silvestre de Tamaulipas preocupa a ganaderos",
    "Cuarentena por peste porcina clásica en granjas de cerdo de Guanajuato",
    "Un laboratorio creó la enfermedad, asegura una cadena de mensajes",
    "Detectan gusano barrenador en oveja y cabra de Chihuahua",
    "Concierto de verano reúne a miles de personas en Veracruz",
    "Barrenador",
    "Vacunación contra la gripe aviar en gallina de Jeff Davis y Texas",
)
LINES = (
    "El boletín oficial informa de un caballo con gusano barrenador en Presidio, Texas, y refuerza la vigilancia.",
    "SENASICA declaró cuarentena tras 12 casos confirmados en aves de corral de Chiapas.",
    "Usuarios afirman que las autoridades ocultan el brote en Oaxaca desde hace semanas.",
    "La vacuna contra la influenza aviar se aplicará en granjas de bovino y aves de Texas.",
    "Se reportan 45 animales muertos y 3 casos activos en la frontera con Estados Unidos.",
    "El mercado local abrió con pocos cambios y los precios siguen estables esta semana.",
    "WOAH confirma gripe aviar H5N1 en ganado bovino de Estados Unidos y pide bioseguridad en cada corral.",
    "La propagación de la miasis en venado preocupa: es el primer foco del siglo en Tamaulipas.",
    "Hay riesgo de expansión de la peste porcina en granjas de cerdo de Guanajuato y Veracruz.",
    "Un mensaje dice que el laboratorio fabricó un arma biológica, sin aportar ninguna prueba.",
    "Hallan oveja y cabra con gusano barrenador en Chihuahua; el sacrificio sanitario empieza hoy.",
    "La música en la plaza terminó tarde y no hubo incidentes que lamentar en la ciudad.",
    "Aphis reports new world screwworm in a dog of New Mexico, the first case in fifty years there.",
    "La erradicación avanza. El 30% de las moscas estériles llegó a México este mes.",
    "Latest news: enable cookies and javascript to read all submissions must be complete.",
    "El gobierno niega que exista un rebrote de gripe aviar en gallina de Jeff Davis.",
)
PLACES_OF = ("https://www.woah.org/es/nota-", "https://www.gob.mx/senasica/avian-influenza/", "https://diario.example.com/n/", "https://youtu.be/watch?v=", "https://x.com/u/status/", "https://doi.org/10.1/", "http://aphis.usda.gov/screwworm/", "https://radio.example.org/bird-flu/")
KINDS = ("news", "official", "veterinary_media", "social", "blog")
FORMATS = ("rss", "html", "fixture", "corpus")
VERDICTS = ("Respaldado", "Insuficiente", "Contradicho", "Revisión humana", "Engañoso", "", "Sin verificar")
LABELS = ("Supported", "Contradicted", "Unknown", "")
COUNTRIES = ("MX", "US", "", "ES", "XX", "AR")
ORGS = {"senasica": "SENASICA", "woah": "WOAH", "omsa": "WOAH", "aphis": "APHIS", "gobierno": "Gobierno"}
COUNTRY_NAMES = {"estados unidos": "US", "méxico": "MX", "texas": "US", "new mexico": "US", "chiapas": "MX", "oaxaca": "MX"}
ANIMAL_NAMES = {"ganado bovino": "bovino", "aves de corral": "aves", "caballo": "caballo", "venado": "venado", "dog": "perro", "oveja": "ovino"}


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, i: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(i).cast("int") + 1)


def articles(spark, d) -> DataFrame:
    """Documents as articles: what a headline, snippet or address begins with is told by the length of the text (k), the rest of each is the text itself."""
    flat = lambda x: F.translate(x, "\n\t", "  ")
    # cut before it is translated, which costs time for each character
    cut = lambda at, n: flat(F.substring("own", at, n))
    rows = table(spark, d, "documents").withColumns({"k": F.coalesce("n_chars", F.lit(0)), "own": F.coalesce("text", F.lit(""))})
    return rows.select(
        "doc_id", F.concat_ws(" ", _pick(TITLES, "k % 14"), cut(1, 24)).alias("title"), F.concat_ws(" ", _pick(LINES, "k % 16"), _pick(LINES, "(k * 7 + 3) % 16"), "text").alias("text"),
        F.concat_ws(" ", _pick(LINES, "(k * 5 + 1) % 16"), cut(25, 40)).alias("snippet"), F.concat(_pick(PLACES_OF, "k % 8"), F.substring(F.sha2(flat(F.col("own")), 256), 1, 12)).alias("url"), F.col("source").alias("source_id"), _pick(KINDS, "k % 5").alias("kind"),
        _pick(FORMATS, "k div 3 % 4").alias("raw_format"), F.when(F.col("k") % 9 != 0, F.col("k") * 37 % 101).alias("risk"), _pick(VERDICTS, "k % 7").alias("verdict"), _pick(LABELS, "k div 2 % 4").alias("nli"),
        _pick(COUNTRIES, "k % 6").alias("country"), F.expr("date_add(date'2026-01-01', cast(k * 13 % 120 as int))").alias("day"),
    )


ARTICLES = f"""(select doc_id, ({_sql_list(TITLES)})[k % 14 + 1] || ' ' || substr(own, 1, 24) as title, concat_ws(' ', ({_sql_list(LINES)})[k % 16 + 1], ({_sql_list(LINES)})[(k * 7 + 3) % 16 + 1], text) as text,
 ({_sql_list(LINES)})[(k * 5 + 1) % 16 + 1] || ' ' || substr(own, 25, 40) as snippet, ({_sql_list(PLACES_OF)})[k % 8 + 1] || left(sha256(own), 12) as url, source as source_id, ({_sql_list(KINDS)})[k % 5 + 1] as kind, ({_sql_list(FORMATS)})[k // 3 % 4 + 1] as raw_format,
 case when k % 9 <> 0 then k * 37 % 101 end as risk, ({_sql_list(VERDICTS)})[k % 7 + 1] as verdict, ({_sql_list(LABELS)})[k // 2 % 4 + 1] as nli, ({_sql_list(COUNTRIES)})[k % 6 + 1] as country,
 date '2026-01-01' + (k * 13 % 120)::int as day from (select *, coalesce(n_chars, 0) as k, translate(coalesce(text, ''), chr(10) || chr(9), '  ') as own from documents))"""


# SQL pieces


def _holds(b: str, needles, letters: str = facts.LETTERS) -> str:
    own = [t for t in needles if facts.strict(t)]
    tests = [f"regexp_matches({b}, '(^|[^{letters}])({'|'.join(map(text.quoted, own))})([^{letters}]|$)')"] if own else []
    return "(" + " or ".join([*tests, *[f"contains({b}, '{t}')" for t in needles if not facts.strict(t)]]) + ")"


def _named(b: str, named) -> str:
    cases = ", ".join(f"case when {_holds(b, needles)} then '{name}' end" for name, needles in named.items())
    return f"list_filter([{cases}], lambda v: v is not null)"


def _any(b: str, needles) -> str:
    return "(" + " or ".join(f"contains({b}, '{n}')" for n in needles) + ")"


def _facts(x: str) -> str:
    b = f"regexp_replace(lower(coalesce({x}, '')), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')"
    return f"{{diseases: {_named(b, facts.DISEASES)}, places: {_named(b, facts.PLACES)}, animals: {_named(b, facts.ANIMALS)}, novelty: {_any(b, facts.NOVELTY)}}}"


def _tokens(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-záéíóúñ0-9]{{3,}}')), lambda t: not regexp_matches(t, '^[0-9]+$') and not list_contains({_sql_list(facts.STOP)}, t))"


def _usable(x: str) -> str:
    return f"(not {_any(f'lower({x})', facts.NOISE)} and not contains(substr(lower({x}), 1, 50), 'latest news'))"


def _both(a: str, b: str) -> str:
    return f"list_filter({a}, lambda v: list_contains({b}, v))"


def _less(a: str, b: str) -> str:
    return f"list_filter({a}, lambda v: not list_contains({b}, v))"


def _compare(a: str, b: str) -> str:
    """status, stance, why, places, animals of facts a and b."""
    d, p, n = (f"len({_both(f'{a}.{k}', f'{b}.{k}')})" for k in ("diseases", "places", "animals"))
    places, animals = (f"list_sort({_both(f'{a}.{k}', f'{b}.{k}')})" for k in ("places", "animals"))
    hit = f"((len({a}.places) = 0 or {p} > 0) and (len({a}.animals) = 0 or {n} > 0) and ({p} > 0 or {n} > 0 or ({a}.novelty and {b}.novelty)))"
    missing_p, missing_a, extra_a = _less(f"{a}.places", f"{b}.places"), _less(f"{a}.animals", f"{b}.animals"), _less(f"{b}.animals", f"{a}.animals")
    why = f"""case when {d} = 0 then 'El fragmento no habla de la misma enfermedad.' when {hit} then 'El boletín oficial afirma los mismos hechos (enfermedad' || case when {p} > 0 then ', lugar' else '' end || case when {n} > 0 then ', animal' else '' end || ').'
      when {p} + {n} > 0 then 'Coincide en la enfermedad' || case when {p} > 0 then '; y en ' || array_to_string({places}, ', ') else '' end || case when len({missing_a}) > 0 then '; no menciona ' || array_to_string({missing_a}, ', ') when len({extra_a}) > 0 then '; habla de ' || array_to_string({extra_a}, ', ') || ', no de lo que dice la nota' else '' end
      || case when len({missing_p}) > 0 then '; no sitúa el hecho en ' || array_to_string(({missing_p})[1:2], ', ') else '' end || '.' else 'Nombra la enfermedad, pero no el lugar ni el animal de esta nota.' end"""
    status = f"case when {d} = 0 then 'none' when {hit} then 'hit' when {p} + {n} > 0 then 'partial' else 'none' end"
    return f"{{status: {status}, stance: case when {d} > 0 and {hit} then 'Supported' end, why: {why}, places: {places}, animals: {animals}}}"


def _paragraphs(source: str, keys: str, claim: str, body: str) -> str:
    """keys, paragraph, score of the best window of each row of source."""
    return f"""(with r as (select {keys}, {_facts(claim)} as f, {_tokens(claim)} as own, {collapse_sql(f"coalesce({body}, '')")} as flat from {source}),
    s as (select {keys}, f, own, list_filter(list_transform(string_split(regexp_replace(flat, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(30), 'g'), chr(30)), lambda v: trim(v)), lambda v: length(v) >= 40 and {_usable('v')}) as parts from r where length(flat) >= 40),
    w as (select {keys}, f, own, pos, trim(parts[pos] || ' ' || coalesce(parts[pos + 1], '')) as w from (select *, unnest(range(1, len(parts) + 1)) as pos from s)),
    g as (select *, {_facts('w')} as g, {_less(_both('own', _tokens('w')), _sql_list(facts.ANCHORS))} as shared from w where {_usable('w')}),
    p as (select *, 2 * len({_both('f.diseases', 'g.diseases')}) + 3 * len({_both('f.places', 'g.places')}) + 3 * len({_both('f.animals', 'g.animals')}) + case when f.novelty and g.novelty then 2 else 0 end as score from g)
    select {keys}, substr(w, 1, 700) as paragraph, score::int as score from (select *, row_number() over (partition by {keys} order by score desc, pos) as turn from p where score > 0 and (len(shared) >= 2 or score >= 3)) where turn = 1)"""


def _stance(claim: str, snippet: str, url: str) -> str:
    host = f"regexp_replace(lower(regexp_extract(coalesce({url}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
    from marisma.functions.urls import OFFICIAL

    official = "(" + " or ".join(f"{host} = '{o}' or ends_with({host}, '.{o}')" for o in OFFICIAL) + ")"
    shared = _both(_tokens(claim), _tokens(snippet))
    held = _both(shared, _sql_list(facts.ANCHORS))
    against = f"({_any(f'lower({claim})', facts.MISINFORMATION)} and ({official} or {_any(f'lower({snippet})', facts.BODIES)}) and not {_any(f'lower({snippet})', facts.MISINFORMATION)})"
    return f"case when trim(coalesce({snippet}, '')) = '' then 'Unknown' when {against} then 'Contradicted' when {official} and len({_tokens(claim)}) >= 5 and len({shared}) >= 6 and len({held}) >= 2 and len({shared}) - len({held}) >= 2 then 'Supported' else 'Unknown' end"


def _first(x: str, named) -> str:
    order = sorted(named, key=len, reverse=True)
    return "case " + " ".join(f"when contains(lower({x}), '{n}') then '{named[n]}'" for n in order) + " else '' end"


_IDS = {facts.DISEASE_IDS[k]: v for k, v in facts.DISEASES.items()}


@query(f"""select doc_id, array_to_string(f.diseases, '|') as diseases, array_to_string(f.places, '|') as places, array_to_string(f.animals, '|') as animals, f.novelty as novelty,
 array_to_string(f.diseases || f.places[1:3] || f.animals[1:2] || case when f.novelty then ['primer caso'] else [] end, '|') as labels from (select doc_id, {_facts("title || '. ' || text")} as f from {ARTICLES})""")
def facts_extract(spark, d):
    rows = text.once(articles(spark, d).select("doc_id", "title", "text"), f=facts.extract(F.concat_ws(". ", "title", "text")))
    join = lambda c: F.array_join(c, "|")
    return rows.select("doc_id", join(F.col("f.diseases")).alias("diseases"), join(F.col("f.places")).alias("places"), join(F.col("f.animals")).alias("animals"), F.col("f.novelty").alias("novelty"), join(facts.labels(F.col("f"))).alias("labels"))


@query(f"select doc_id, score, sha256(paragraph) as paragraph_sha256 from {_paragraphs(ARTICLES, 'doc_id', 'title', 'text')}")
def paragraph_pick(spark, d):
    return reviews.paragraphs(articles(spark, d), ["doc_id"], "title", "text").select("doc_id", "score", F.sha2("paragraph", 256).alias("paragraph_sha256"))


@query(f"""select doc_id, c.status as status, c.stance as stance, c.why as why, array_to_string(c.places, '|') as places, array_to_string(c.animals, '|') as animals from (
 select doc_id, {_compare('a', 'b')} as c from (select doc_id, {_facts('title')} as a, {_facts('snippet')} as b from {ARTICLES}))""")
def facts_contrast(spark, d):
    rows = text.once(articles(spark, d).select("doc_id", "title", "snippet"), a=facts.extract(F.col("title")), b=facts.extract(F.col("snippet")))
    rows = text.once(rows, c=facts.compare(F.col("a"), F.col("b")))
    return rows.select("doc_id", "c.status", "c.stance", "c.why", F.array_join("c.places", "|").alias("places"), F.array_join("c.animals", "|").alias("animals"))


@query(f"select doc_id, {_stance('title', 'snippet', 'url')} as stance, {_stance('title', 'text', 'url')} as body_stance from {ARTICLES}")
def stance_rules(spark, d):
    a = articles(spark, d)
    return a.select("doc_id", facts.stance(F.col("title"), F.col("snippet"), F.col("url")).alias("stance"), facts.stance(F.col("title"), F.col("text"), F.col("url")).alias("body_stance"))


_KIND = "case " + " ".join(f"when regexp_matches(lower(s), '{p}') then {i}" for i, p in enumerate(facts.CLAIM_KINDS.values())) + " end"
_PREDICATE = "case " + " ".join("when regexp_matches(claim, '" + p.replace("\\b", "(^|[^A-Za-z0-9_áéíóúñüÁÉÍÓÚÑÜ])", 1) + f"') then '{n}'" for p, n in text.PREDICATES) + " else 'AFIRMA' end"


@query(f"""with a as (select doc_id, text, {_named('lower(text)', _IDS)} as diseases from {ARTICLES}),
s as (select doc_id, diseases, pos, trim(parts[pos]) as s from (select *, unnest(range(1, len(parts) + 1)) as pos from (select doc_id, diseases, regexp_extract_all(text, '[^.!?]*[.!?]') as parts from a))),
k as (select *, {_KIND} as kind from s where length(s) >= 20),
u as (select doc_id, s as claim, any_value(diseases) as diseases, min({{kind: kind, pos: pos}}) as best from k where kind is not null group by doc_id, s),
t as (select doc_id, row_number() over (partition by doc_id order by best) as turn, claim, ({_sql_list(facts.CLAIM_KINDS)})[best.kind + 1] as kind, diseases from u),
c as (select * from t where turn <= 8 union all select doc_id, 1, trim(substr(text, 1, 240)), '', diseases from a where doc_id not in (select doc_id from t) and trim(text) <> ''),
b as (select *, {_first('claim', ORGS)} as org, {_named('lower(claim)', _IDS)} as own from c),
j as (select *, case when org <> '' then org when len(own) > 0 then list_min(own) else substr(split_part(trim(claim), ' ', 1), 1, 40) end as subject, {_PREDICATE} as predicate from b)
select doc_id, turn::int as turn, kind, substr(sha256(substr(claim, 1, 200)), 1, 32) as claim_id, subject, predicate,
 substr({collapse_sql("regexp_replace(regexp_replace(claim, '(?i)' || regexp_escape(subject), ' ', 'g'), '(?i)' || regexp_escape(predicate), ' ', 'g')")}, 1, 240) as object,
 {_first('claim', COUNTRY_NAMES)} as location, {_first('claim', ANIMAL_NAMES)} as animal, len(diseases) > 0 or regexp_matches(claim, '[0-9]') or subject in {tuple(sorted(set(ORGS.values())))} or kind in {facts.CHECKABLE} as verifiable from j""")
def claim_patterns(spark, d):
    out = reviews.claims(articles(spark, d), "doc_id", F.col("text"), facts.canonical(F.lower("text"), _IDS), ORGS, COUNTRY_NAMES, ANIMAL_NAMES)
    return out.drop("claim")


_AGREE = f"""(with c as (select doc_id, title, {_facts('title')} as f from {ARTICLES}),
 n as (select trim(regexp_replace(lower(title), '[^a-z0-9áéíóúñ]+', ' ', 'g')) as norm, min(doc_id) as peer, min_by(title, doc_id) as title, min_by(f, doc_id) as f from c group by 1),
 p as (select distinct c.doc_id, n.norm, n.peer, n.title from c join n on c.doc_id <> n.peer and len({_both('c.f.diseases', 'n.f.diseases')}) > 0 and len({_both('c.f.places', 'n.f.places')}) + len({_both('c.f.animals', 'n.f.animals')}) > 0)
 select doc_id, title, peer from (select *, row_number() over (partition by doc_id order by norm) as turn from p) where turn <= 8)"""


def _peers(a: DataFrame) -> DataFrame:
    named = text.once(a.select("doc_id", "title"), f=facts.extract(F.col("title")))
    return reviews.agreeing(named.select("doc_id", "f"), named.select(F.col("doc_id").alias("peer"), "title", "f"), "doc_id")


@query(f"select doc_id, title, peer from {_AGREE}")
def corpus_agreement(spark, d):
    return _peers(articles(spark, d))


_EVIDENCE = f"(select doc_id, title as claim, snippet, url as title, 1 as n from {ARTICLES} union all select doc_id, title, substr(text, 1, 300), url || '#2', 2 from {ARTICLES} where doc_id % 2 = 0)"
_TOLD = "format('{:d} nota(s) de prensa del recorte coinciden', peers)"


@query(f"""with e as (select * from {_EVIDENCE} where length(trim(snippet)) >= 40), p1 as (select * from {_paragraphs('e', 'doc_id, n', 'claim', 'snippet')}),
u as (select e.doc_id, e.n, e.claim, e.title, coalesce(p1.paragraph, trim(e.snippet)) as use from e left join p1 using (doc_id, n)), p2 as (select * from {_paragraphs('u', 'doc_id, n', 'claim', 'use')}),
c as (select u.doc_id, u.n, u.title, u.use, {_compare('x', 'y')} as c, coalesce(p2.score, 0) as points from (select *, {_facts('claim')} as x, {_facts('use')} as y from u) u left join p2 using (doc_id, n)),
b as (select * from (select *, row_number() over (partition by doc_id order by case c.status when 'hit' then 30 else 15 end + 8 + points desc, n) as turn from c where c.status <> 'none') where turn = 1),
q as (select doc_id, least(count(*), 6)::bigint as peers from {_AGREE} group by doc_id),
j as (select a.doc_id, b.c as c, b.use, b.title, coalesce(q.peers, 0)::bigint as peers, b.doc_id is not null as there from {ARTICLES} a left join b using (doc_id) left join q using (doc_id))
select doc_id, coalesce(c.status, case when peers > 0 then 'peer' else 'none' end) as status, c.stance as stance, sha256(substr(use, 1, 900)) as snippet_sha256, title,
 case when there and c.status = 'partial' and peers > 0 then c.why || ' ' || {_TOLD} || ' en el mismo hecho.' when there then c.why when peers > 0 then {_TOLD} || ' en estos hechos. No hay boletín oficial de este caso en el recorte.' else 'No hay boletín oficial ni otras notas del recorte que afirmen, desmientan o contradigan estos hechos.' end as why, peers from j""")
def review_contrast(spark, d):
    a = articles(spark, d)
    one = a.select("doc_id", "snippet", F.col("url").alias("title"), F.lit(1).alias("n"))
    two = a.where("doc_id % 2 = 0").select("doc_id", F.substring("text", 1, 300).alias("snippet"), F.concat("url", F.lit("#2")).alias("title"), F.lit(2).alias("n"))
    out = reviews.contrast(a.select("doc_id", F.col("title").alias("claim")), one.unionByName(two), _peers(a), "doc_id")
    return out.select("doc_id", "status", "stance", F.sha2("snippet", 256).alias("snippet_sha256"), "title", "why", "peers")


@query(f"""with c as (select doc_id, title, case when length(t) < 24 then -99 else case when doc_id % 2 = 0 then 2 else 0 end + case when nli in ('Supported', 'Contradicted') then 3 else 0 end + least(4, len({_both(_tokens('t'), _tokens('title'))}))
 + case when len({_both(_tokens('t'), _sql_list(facts.ANCHORS))}) > 0 then 2 else 0 end - case when len({_tokens('t')}) > 80 then 2 else 0 end end as score, t from (select doc_id, nli, title, {collapse_sql("regexp_replace(coalesce(snippet, ''), '(?is)[ ]*20[0-9]{6}T[0-9]{6,9}Z.*$', '')")} as t from {ARTICLES}))
select doc_id, score::int as score, case when score < 0 then title when len({_both(_tokens('t'), _tokens('title'))}) < 2 and len({_tokens('title')}) >= 4 then title else t end as claim from c""")
def review_claim(spark, d):
    return relevance.review_claim(articles(spark, d), F.col("snippet"), F.col("title"), F.col("doc_id") % 2 == 0, F.col("nli")).select("doc_id", "score", "claim")


_TOPIC = f"({' + '.join(_holds('b', [w], relevance.LETTERS) + '::int' if facts.strict(w) else f'''contains(b, '{w}')::int''' for w in relevance.TOPIC)})"
_TITLE_TOPIC = _TOPIC.replace("(b,", "(lower(title),")
_WEAK = f"({' or '.join(_holds('b', [w], relevance.LETTERS) if facts.strict(w) else f'''contains(b, '{w}')''' for w in relevance.WEAK)})"
_HOST = "regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
CATEGORIES = ("general", "Veterinary", "news", "surveillance")
_CATEGORY = f"({_sql_list(CATEGORIES)})[doc_id // 5 % 4 + 1]"
_ASSIGNED = "doc_id % 11 = 0"
_WATCHED = f"(replace(lower(kind), ' ', '_') in {relevance.KEEP_KINDS} or lower({_CATEGORY}) in {relevance.KEEP_CATEGORIES} or {_ASSIGNED} or {_any(_HOST, relevance.KEEP_DOMAINS)})"
_SKIP = "case when length(trim(title)) >= 20 and not watched and least(1.0, th / 3.0) < 0.15 then true when score >= 0.15 then false when watched and (score > 0 or weak or named) then false else true end"
_RELEVANCE = f"""(select *, {_SKIP} as skip from (select *, least(1.0, h / 3.0)::double as score, false as named from (select *, {_TOPIC} as h, {_TITLE_TOPIC} as th, {_WEAK} as weak, {_WATCHED} as watched from (select *, lower(title || ' ' || text) as b from {ARTICLES}))))"""


def judged(rows: DataFrame) -> DataFrame:
    """Articles with the relevance that their text, kind, host, and their source's category and diseases give them."""
    assigned = F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("gripe_aviar")))
    return relevance.judged(rows, F.concat_ws(" ", "title", "text"), F.col("title"), F.col("kind"), urls.host(F.col("url")), _pick(CATEGORIES, "doc_id div 5 % 4"), assigned)


@query(f"""select doc_id, score, skip, watched and not skip as kept, case when skip then 'discard' when score < 0.5 then 'low' when score < 0.8 then 'analyze' else 'high' end as bucket, array_to_string(list_sort({_named('b', _IDS)}), '|') as diseases from {_RELEVANCE}""")
def relevance_rules(spark, d):
    a = judged(articles(spark, d))
    return a.select("doc_id", "score", "skip", "kept", "bucket", F.array_join(F.array_sort(facts.canonical(F.lower(F.concat_ws(" ", "title", "text")), _IDS)), "|").alias("diseases"))


@query(f"""select doc_id, score, {_SKIP} as skip, watched from (select *, least(1.0, h / 3.0)::double as score from (select *, '' as title, 0 as th, {_TOPIC} as h, {_WEAK} as weak, source in ('src0', 'src3') or assigned as watched, assigned and length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 80 as named
 from (select *, lower(coalesce(text, '')) as b, doc_id % 2 = 0 as assigned from documents)))""")
def relevance_sources(spark, d):
    """Whole texts of documents as they are: some sources are official, every second one has a disease assigned, so that short texts stay."""
    kind = F.when(F.col("source").isin("src0", "src3"), "Official International")
    assigned = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("gripe_aviar")))
    rows = relevance.judged(table(spark, d, "documents"), F.col("text"), F.lit(""), kind, F.lit(""), None, assigned)
    return rows.select("doc_id", "score", "skip", F.coalesce(relevance.watched(kind, F.lit(""), F.lit(""), assigned), F.lit(False)).alias("watched"))


_ORIGIN = """case when contains(lower(url), 'youtube') or contains(lower(url), 'youtu.be') then 'youtube' when regexp_matches(lower(url), 'openalex\\.org|pubmed|doi\\.org') or regexp_matches(l, 'pubmed|openalex') then 'cientifico'
 when regexp_matches(lower(url), 'woah\\.org|oie\\.int|senasica|gob\\.mx|fao\\.org|who\\.int|cdc\\.gov|usda\\.gov') or regexp_matches(l, 'senasica|official portal') or contains(t, 'oficial') then 'oficial'
 when regexp_matches(lower(url), 'twitter\\.com|x\\.com|facebook\\.com|linkedin\\.com|reddit\\.com') or regexp_matches(t, 'social|twitter|linkedin|facebook') then 'social' else 'prensa' end"""
_LISTED = f"(select *, {_ORIGIN} as origin, {_named('b', _IDS)} as diseases from (select *, lower(title || ' ' || text) as l, lower(kind || ' ' || raw_format) as t from {_RELEVANCE}))"
_CONDITIONS = {
    "redes": "origin = 'social'", "prensa": "origin = 'prensa'", "unknown_origin": "true", "disease": "list_contains(diseases, 'gripe_aviar')", "disease_alias": "list_contains(diseases, 'gusano_barrenador')",
    "country": "upper(country) = 'MX'", "stance": "(contains(lower(nli), 'support') or contains(lower(nli), 'respald'))", "risk": "risk >= 40 and risk <= 70", "no_risk": "risk is null",
    "verdict": "(contains(lower(verdict), 'contradicho') or contains('contradicho', lower(verdict)) or contains(lower(verdict), 'contrad'))", "format": "raw_format = 'fixture'", "period": "day >= date '2026-02-01' and day <= date '2026-03-01'", "text": "contains(lower(title || ' ' || text || ' ' || source_id), 'texas')",
}
_PARAMETERS = {
    "redes": {"origin": "Redes"}, "prensa": {"origin": "prensa"}, "unknown_origin": {"origin": "radio"}, "disease": {"disease": "gripe_aviar"}, "disease_alias": {"disease": "Gusano Barrenador"}, "country": {"country": "mx"}, "stance": {"stance": "respaldado"},
    "risk": {"min_risk": 40, "max_risk": 70}, "no_risk": {"risk_null": "1", "min_risk": 90}, "verdict": {"verdict": "Contradicho"}, "format": {"raw_format": "Fixture"}, "period": {"since": "2026-02-01", "until": "2026-03-01"}, "text": {"text": "TEXAS"},
}
_OPEN = "(raw_format in ('fixture', 'corpus') or not skip)"


def _listed(spark, d, shown=True):
    """Articles with diseases and origin; judged only where it matters which are shown."""
    a = articles(spark, d).withColumn("diseases", facts.canonical(F.lower(F.concat_ws(" ", "title", "text")), _IDS))
    return listing.prepared(judged(a) if shown else a)


@query(" union all ".join(f"select '{k}' as filter, count(*)::bigint as n, coalesce(sum(doc_id), 0)::bigint as ids from {_LISTED} where {_OPEN} and {c}" for k, c in _CONDITIONS.items()))
def articles_filters(spark, d):
    """One pass over the articles for all the filters: each is a condition that is counted."""
    rows = _listed(spark, d)
    tests = [(k, filters.ArticleQuery.parse(source_column="source_id", **p).condition() & listing.shown()) for k, p in _PARAMETERS.items()]
    counts = rows.agg(*[F.struct(F.count_if(c).alias("n"), F.coalesce(F.sum(F.when(c, F.col("doc_id"))), F.lit(0)).alias("ids")).alias(k) for k, c in tests])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("filter"), F.col(f"{k}.n").alias("n"), F.col(f"{k}.ids").alias("ids")) for k, _ in tests])).alias("r")).select("r.*")


@query(f"select doc_id, title, day, risk, origin from {_LISTED} where {_OPEN} and origin = 'oficial' and risk >= 20 order by day desc, doc_id limit 12 offset 12")
def articles_page(spark, d):
    q = filters.ArticleQuery.parse(origin="oficial", min_risk=20, page="2")
    return filters.page(_listed(spark, d).where(q.condition() & listing.shown()), [F.desc("day"), F.col("doc_id")], q.page, q.size).select("doc_id", "title", "day", "risk", "origin")


_KEYS = ("respaldado", "insuficiente", "contradicho", "revision_humana", "enganoso", "sin_verificar")
_VERDICT = "case when contains(v, 'respald') or v = 'supported' then 'respaldado' when contains(v, 'insufic') then 'insuficiente' when contains(v, 'contrad') then 'contradicho' when regexp_matches(v, 'humana|revision|review') then 'revision_humana' when regexp_matches(v, 'engañ|engan|mislead') then 'enganoso' else 'sin_verificar' end"


@query(f"""with f as (select {_VERDICT.replace('(v,', '(lower(trim(verdict)),').replace('v = ', 'lower(trim(verdict)) = ')} as verdict_key, * from {_LISTED}),
c as (select 'verdict' as facet, verdict_key as key, count(*) as n from f group by 2 union all select 'origin', origin, count(*) from f group by 2 union all select 'disease', dis, count(*) from (select unnest(case when len(diseases) > 0 then diseases else ['otras'] end) as dis from f) group by 2),
w as (select 'verdict' as facet, unnest({_sql_list(_KEYS)}) as key union all select 'origin', unnest(['youtube', 'cientifico', 'oficial', 'social', 'prensa']) union all select 'disease', unnest({_sql_list([*_IDS, 'otras'])}))
select facet, key, coalesce(n, 0)::bigint as n from w left join c using (facet, key)""")
def chart_facets(spark, d):
    rows = _listed(spark, d, shown=False).withColumn("verdict_key", filters.verdict_key(F.col("verdict")))
    return listing.facets(rows, {"verdict": (F.array("verdict_key"), _KEYS), "origin": (F.array("origin"), filters.ORIGINS), "disease": (F.when(F.size("diseases") > 0, F.col("diseases")).otherwise(F.array(F.lit("otras"))), (*_IDS, "otras"))})


@query(f"""with days as (select unnest(generate_series((select min(day) from {ARTICLES})::timestamp, (select max(day) from {ARTICLES})::timestamp, interval 1 day))::date as day),
g as (select day, count(*) as n, count(*) filter (where risk is null) as unknown_risk, count(*) filter (where risk >= 55) as alerts, round(avg(risk), 1) as mean_risk, list(title order by doc_id)[1:3] as titles from {ARTICLES} group by day)
select day, coalesce(n, 0)::bigint as n, coalesce(unknown_risk, 0)::bigint as unknown_risk, coalesce(alerts, 0)::bigint as alerts, mean_risk, coalesce(array_to_string(titles, '|'), '') as titles from days left join g using (day)""")
def chart_daily(spark, d):
    return listing.daily(articles(spark, d), "day", "doc_id", "title", "risk").withColumn("titles", F.array_join("titles", "|"))


@query(f"""with a as (select country, day, risk, case when len(diseases) > 0 then diseases else ['otras'] end as ds from {_LISTED} where country not in ('', 'XX')), n as (select country, count(*) as n, count(*) filter (where risk >= 55) as alerts, min(day) as first_seen from a group by country),
c as (select country, dis, count(*) as k from (select country, unnest(ds) as dis from a) group by 1, 2)
select country, n::bigint as n, alerts::bigint as alerts, strftime(first_seen, '%Y-%m-%d') as first_seen, round(sqrt(n::double / max(n) over ()), 4) as radius, (select string_agg(dis || ':' || k, '|' order by k desc, dis) from c where c.country = n.country) as diseases from n""")
def geo_table(spark, d):
    return listing.by_country(_listed(spark, d, shown=False).where("country not in ('', 'XX')"), "country", "day", "risk", "diseases")


@query(f"""select 'articles' as what, count(*)::bigint as n from {ARTICLES} union all select 'alerts', count(*)::bigint from {ARTICLES} where risk >= 55 or lower(verdict) in ('contradicho', 'engañoso', 'revisión humana') union all select 'unverified', count(*)::bigint from {ARTICLES} where nli in ('Unknown', '')
 union all select 'sources', count(distinct source_id)::bigint from {ARTICLES} union all select 'relevant', count(*)::bigint from {_RELEVANCE} where not skip""")
def route_kpis(spark, d):
    return listing.kpis(_listed(spark, d))


_HIDING = "regexp_matches(lower(s), 'ocult')"


@query(f"""with a as (select doc_id, title, nli, snippet as s, doc_id % 3 as structures from {ARTICLES}), c as (select doc_id, structures, {_HIDING} and not regexp_matches(lower(s), 'usuarios afirman|niega que') as hidden, [nli, ({_sql_list(LABELS)})[(doc_id + 1) % 4 + 1]] as labels from a),
b as (select *, list_transform(labels, lambda v: case when contains(lower(v), 'contrad') then 'contradicha' when regexp_matches(lower(v), 'support|respald') then 'respaldada' else 'no_verificable' end) as k from c)
select doc_id, case when len(list_filter(k, lambda v: v = 'contradicha')) >= 1 then 'contradicha' when list_contains(k, 'respaldada') and structures = 0 then case when len(list_distinct(k)) > 1 then 'parcial' else 'respaldada' end
 when hidden and structures >= 1 and not list_contains(k, 'respaldada') then 'prioridad_investigacion' else 'no_verificable' end as code from b""")
def narrative_code(spark, d):
    a = articles(spark, d)
    low = F.lower("snippet")
    rows = a.select("doc_id", (F.col("doc_id") % 3).alias("structures"), (low.rlike("ocult") & ~low.rlike("usuarios afirman|niega que")).alias("hidden"), F.array("nli", _pick(LABELS, "(doc_id + 1) % 4")).alias("labels"))
    return rows.select("doc_id", stories.narrative(F.col("labels"), F.col("structures"), F.col("hidden")).alias("code"))


_SPECS = {"barrenador": (("enfermedad", "lugar"), ()), "vacunas": (("enfermedad",), ("vacuna",)), "vacia": ((), ("laboratorio",))}


@query(f"""with h as (select doc_id, lower(title || ' ' || snippet) as l, {{d: {_facts("title || ' ' || snippet")}}} as f, doc_id % 3 = 0 as structures from {ARTICLES}),
c as (select *, list_filter([case when len(f.d.diseases) > 0 then 'enfermedad' end, case when len(f.d.places) > 0 then 'lugar' end, case when len(f.d.animals) > 0 then 'animal' end], lambda v: v is not null) as cats, len(f.d.diseases) >= 2 as strong from h)
""" + " union all ".join(
    f"select '{name}' as narrative, doc_id from c where "
    + (f"{_any('l', extra)} and " if extra else "") + (f"list_has_any(cats, {_sql_list(need)})" if need else "false")
    for name, (need, extra) in _SPECS.items()
))
def narrative_match(spark, d):
    rows = text.once(articles(spark, d).select("doc_id", F.concat_ws(" ", "title", "snippet").alias("t")), f=facts.extract(F.col("t")))
    cats = F.array_compact(F.array(*[F.when(F.size(F.col("f")[k]) > 0, name) for k, name in (("diseases", "enfermedad"), ("places", "lugar"), ("animals", "animal"))]))
    rows = text.once(rows.withColumn("low", F.lower("t")), cats=cats).withColumn("strong", F.size("f.diseases") >= 2).withColumn("structures", F.col("doc_id") % 3 == 0)
    return stories.matches(rows, "doc_id", _SPECS, "low", "cats", "strong", "structures")


def near(spark, d) -> DataFrame:
    """What tells the peers of articles: doc_id, country, day, tags. Read from the texts once and set down, since peers looks at it from many sides; no text is kept."""
    shared_checkpoints(spark)
    return articles(spark, d).select("doc_id", "country", "day", facts.canonical(F.lower("title"), _IDS).alias("tags")).checkpoint()


@query(f"""with a as (select doc_id, country, day, {_named("lower(title)", _IDS)} as tags from {ARTICLES}), x as (select * from a where doc_id % 20 = 0),
p as (select x.doc_id as anchor, a.doc_id as peer, row_number() over (partition by x.doc_id order by a.day desc, a.doc_id) as turn from x join a on a.doc_id <> x.doc_id and (x.country in ('', 'XX', 'INT') or a.country = x.country) and (len(x.tags) = 0 or len(a.tags) = 0 or len({_both('x.tags', 'a.tags')}) > 0) and abs(date_diff('day', x.day, a.day)) <= 7)
select anchor, peer, turn::int as turn from p where turn <= 24""")
def peer_rows(spark, d):
    a = near(spark, d)
    return stories.peers(a.where("doc_id % 20 = 0"), a, "doc_id", "country", "tags", "day")


@query(f"""with a as (select doc_id, source_id, substr(sha256(title), 1, 16) as ph, {_named("lower(title)", _IDS)} as tags from {ARTICLES}), x as (select * from a where doc_id % 20 = 0),
p as (select x.doc_id as query, a.doc_id as match, 4 * len({_both('x.tags', 'a.tags')}) + case when x.ph = a.ph then 8 else 0 end + (x.source_id = a.source_id)::int as score from x join a on x.doc_id <> a.doc_id)
select query, match, score::int as score from (select *, row_number() over (partition by query order by score desc, match) as turn from p where score > 0) where turn <= 10""")
def similar_ranked(spark, d):
    a = articles(spark, d).select("doc_id", "source_id", F.substring(F.sha2("title", 256), 1, 16).alias("ph"), facts.canonical(F.lower("title"), _IDS).alias("tags"))
    return stories.similar(a.where("doc_id % 20 = 0"), a, "doc_id", "tags", "ph", "source_id", 10)


@query(f"""select doc_id, turn::int as turn, day_from, day_to, n::bigint as publications from (with a as (select doc_id as id, day, row_number() over (order by day, doc_id) - 1 as i, count(*) over () as total from {ARTICLES}), c as (select *, least(i // (total // 5), 4) + 1 as turn from a)
 select min(id) as doc_id, turn, min(day) as day_from, max(day) as day_to, count(*) as n from c group by turn)""")
def narrative_stages(spark, d):
    """Five stretches of equal size in time: cut points come from counts of days, so only ids inside the days at a cut are ranked."""
    return stories.stages(articles(spark, d), "doc_id", "day", 5)
