"""Rules that judge an article from its claims, evidence, pictures and peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions import facts, hashing, pictures, scoring, urls
from marisma.operators import facets

# What tells the authority of a source, and which sources count as official.
TYPES = {"A": ("OFFICIAL", "OFFICIAL_NATIONAL", "OFFICIAL_INTERNATIONAL"), "B": ("RESEARCH", "GENOMIC", "EPIDEMIOLOGICAL", "AGRICULTURAL", "FACT_CHECK"), "C": ("NEWS", "GENERAL_MEDIA", "AGGREGATOR"), "D": ("YOUTUBE",), "E": ("SOCIAL", "FORUM")}
CATEGORIES = {"A": ("official",), "B": ("surveillance", "veterinary", "research", "epidemiological", "fact_check"), "C": ("media",), "D": ("youtube",), "E": ("social", "forum")}
DOMAINS = ("woah.org", "oie.int", "who.int", "paho.org", "fao.org", "cdc.gov", "gob.mx", "senasica.gob.mx", "usda.gov", "aphis.usda.gov", "canada.ca", "inspection.gc.ca")
HINTS = ("woah.org", "wahis", "who.int", "paho.org", "fao.org", "cdc.gov", "efsa.europa", "gob.mx", "senasica", "usda.gov", "aphis", "oie.int")
BODIES = ("gob.mx", "usda", "woah", "aphis", "senasica", "tahc", "who.int", "cdc.gov")
# Notes on what a sentence is, by its mode; the first is for those without a sign of hiding.
PRINCIPLE = "Una palabra no es el riesgo. El contexto es el riesgo. El banco marca qué mirar; no declara que una nota sea falsa ni maliciosa. peso ≠ malicia."
NOTES = {
    "pregunta": "Es una pregunta. No se trata como acusación.", "negacion": "La frase niega la acusación de ocultamiento.", "cita": "La acusación está atribuida a otro actor, no necesariamente al autor de la nota.",
    "descripcion": "Describe una investigación o un análisis; no afirma el ocultamiento por sí misma.", "hipotesis": "Está en modo hipótesis o especulación.",
}
QUESTION, HIDING = "Es una pregunta, no una afirmación lista para contrastar como hecho.", "Hay señal de ocultamiento en una afirmación. Hay que contrastar; no es un sello de falsedad."


def _low(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def _of(x: Column, named: dict) -> Column:
    out = F.lit(None).cast("string")
    for grade, values in named.items():
        out = F.when(x.isin(*values), grade).otherwise(out)
    return out


# sources: three different questions, kept apart


def authority(stated: Column, domain: Column, kind: Column, category: Column) -> Column:
    """Grade A to F: as stated, else by an official domain, by type, by category; empty where nothing tells it."""
    own = F.upper(F.trim(F.coalesce(stated, F.lit(""))))
    host = F.ltrim(_low(domain), F.lit("."))
    return F.coalesce(F.when(own.isin(*scoring.AUTHORITY), own), F.when(urls.under(host, DOMAINS), "A"), _of(F.upper(F.coalesce(kind, F.lit(""))), TYPES), _of(_low(category), CATEGORIES), F.lit(""))


def unreliability(grade: Column, kind: Column, category: Column, access: Column, shift: Column) -> Column:
    """How little a source can be relied on, 0 to 100: by its grade, else by its type and the way it is read; moved by what reviewers decided of it."""
    low = F.upper(F.coalesce(kind, F.lit("")))
    base = F.when(low.isin(*TYPES["A"]) | (category == "official"), 12).when(F.contains(low, F.lit("RESEARCH")) | (category == "research"), 20).when(access == "api", 40).otherwise(55)
    return scoring.clip(F.when(grade.isin(*scoring.AUTHORITY), scoring.cases(grade, scoring.AUTHORITY, 55)).otherwise(base) + F.coalesce(shift, F.lit(0)))


def official_row(kind: Column, category: Column, unreliable: Column) -> Column:
    """Official among peers: by type, by category, or by how far it can be relied on."""
    return F.coalesce(F.upper(F.coalesce(kind, F.lit(""))).isin(*TYPES["A"]) | (category == "official"), F.lit(False)) | (unreliable <= 20)


def official_evidence(host: Column, kind: Column, name: Column, category: Column) -> Column:
    """Official as evidence of a narrative: a hint in host, type, name or category."""
    blob = F.concat_ws(" ", _low(host), _low(kind), _low(name), _low(category))
    return facts.any_of(blob, (*HINTS, "oficial"))


def official_source(url: Column, kind: Column, category: Column, domain: Column) -> Column:
    """Official in a contrast of facts: an official host, or a sign in type, category or domain."""
    return urls.under(urls.host(url), urls.OFFICIAL) | facts.any_of(F.concat_ws(" ", _low(kind), _low(category), _low(domain)), ("official", *BODIES))


# claims


def severity(claims: DataFrame, key: str, kind: str, predicate: str, verifiable: str) -> DataFrame:
    """key, severity: how grave the gravest claim of an article is: 80, 45, 35 or 15."""
    return claims.groupBy(key).agg(gravest(kind, predicate, verifiable).alias("severity"))


def gravest(kind: str, predicate: str, verifiable: str) -> Column:
    """The aggregate of claims that severity() gives, to be taken beside others in one pass."""
    grave = (F.coalesce(kind, F.lit("")) == "conspiracion") | F.coalesce(F.col(predicate).isin("OCULTA", "CAUSA"), F.lit(False))
    own = F.when(grave, 80).when(F.col(kind).isin("brote", "cifra"), 45).when(~F.coalesce(verifiable, F.lit(True)), 35).otherwise(15)
    return F.max(own)


def labels(claims: DataFrame, key: str, label: str) -> DataFrame:
    """key, label, counts of an article's claims: contradicted if more are contradicted than supported, supported if any is, else unknown."""
    n = {v: F.count_if(F.col(label) == v) for v in ("Supported", "Contradicted")}
    return claims.groupBy(key).agg(n["Supported"].alias("supported"), n["Contradicted"].alias("contradicted"), F.count(F.lit(1)).alias("claims")).withColumn("label", F.when(F.col("contradicted") > F.col("supported"), "Contradicted").when(F.col("supported") > 0, "Supported").otherwise("Unknown"))


def stances(claims: DataFrame, key: str, label: str, ids: DataFrame | None = None) -> DataFrame:
    """stance, n of Supported, Contradicted and Unknown, which is all else; of the articles in ids, of all where ids has no row."""
    rows = claims
    if ids is not None:
        any_id = ids.select(F.lit(True).alias("_any")).limit(1).agg(F.count(F.lit(1)).alias("_any"))
        rows = claims.join(ids.select(key, F.lit(True).alias("_in")).distinct(), key, "left").crossJoin(F.broadcast(any_id)).where((F.col("_any") == 0) | F.col("_in"))
    kind = F.when(F.col(label).isin("Supported", "Contradicted"), F.col(label)).otherwise("Unknown")
    counts = rows.agg(*[F.count_if(kind == k).alias(k) for k in ("Supported", "Contradicted", "Unknown")])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stance"), F.col(k).alias("n")) for k in counts.columns])).alias("r")).select("r.*")


def cross_cut(articles: DataFrame, key: str, peers: DataFrame) -> DataFrame:
    """key, score, reason, peers: whether sources part over an article. articles has key, nli, severity, official; peers has key (of the article), verdict and official of each peer.

    Peers are counted for each article before they are joined.
    """
    backed, against = F.col("verdict") == "RESPALDADO", F.col("verdict") == "CONTRADICHO"
    n = peers.groupBy(key).agg(F.count_if(backed & F.col("official")).alias("_ok"), F.count_if(backed).alias("_backed"), F.count_if(against).alias("_against"))
    rows = articles.join(n, key, "left").fillna(0, ["_ok", "_backed", "_against"])
    ok = (F.col("_ok") > 0) & ~F.col("official")
    cell = lambda s, r, p: F.struct(F.lit(float(s)).alias("score"), F.lit(r).alias("reason"), p.alias("peers"))
    cut = (
        F.when(ok & ((F.col("nli") == "Contradicted") | (F.col("severity") >= 80)), cell(88, "discrepa_oficial", F.col("_ok"))).when(ok & (F.col("nli") == "Unknown"), cell(58, "no_cuadra_oficial", F.col("_ok")))
        .when((F.col("_backed") > 0) & (F.col("_against") > 0), cell(72, "fuentes_parten", F.col("_backed") + F.col("_against"))).otherwise(cell(0, "", F.lit(0).cast("bigint")))
    )
    return rows.select(key, cut.alias("c")).select(key, "c.*")


def note(mode: Column, hidden: Column) -> Column:
    """What to keep in mind of a sentence, by its mode and whether it has a sign of hiding."""
    out = F.lit(HIDING)
    for name, told in NOTES.items():
        out = F.when(mode == name, told).otherwise(out)
    return F.when(~hidden, F.when(mode == "pregunta", QUESTION).otherwise(PRINCIPLE)).otherwise(out)


def overlap(share: Column) -> Column:
    """struct(verdict, confidence) of the best share of a text's words that evidence has."""
    yes = share >= 0.2
    return F.struct(F.when(yes, "supports").otherwise("insufficient").alias("verdict"), F.round(F.when(yes, F.least(F.lit(0.72), share * 0.55 + 0.32)).otherwise(F.greatest(F.lit(0.12), share * 0.6)), 3).alias("confidence"))


def missing(official: Column, tokens: Column, shared: Column, anchors: Column) -> Column:
    """What keeps a piece of evidence from supporting a claim, as an array of texts."""
    text = lambda x: x.cast("string")
    tests = [
        F.when(~official, "la URL no es dominio oficial"),
        F.when(tokens < 5, F.concat(F.lit("la afirmación tiene "), text(tokens), F.lit(" tokens (mínimo 5)"))),
        F.when(shared < 6, F.concat(F.lit("coinciden "), text(shared), F.lit(" palabras con la ficha (mínimo 6)"))),
        F.when(anchors < 2, F.concat(F.lit("anclas de enfermedad: "), text(anchors), F.lit(" (mínimo 2: h5n1, barrenador, senasica…)"))),
        F.when(shared - anchors < 2, "la ficha nombra la enfermedad, pero no el hecho de la nota (lugar, animal, caso concreto)"),
    ]
    return F.array_compact(F.array(*tests))


# the whole article


def explanation(claims: Column, judged: Column, evidence: Column, images: Column, text: Column, provider: Column) -> Column:
    """struct(score, band, llm_used): how well an article is explained."""
    used = (F.coalesce(text, F.lit("")) != "") & ~F.coalesce(provider, F.lit("")).isin("", "local")
    point = lambda c, n: F.when(c, n).otherwise(0)
    score = F.least(F.lit(100), F.lit(18) + point(claims > 0, 18) + point(judged > 0, 18) + point(evidence > 0, 16) + point(images > 0, 12) + point(used, 18))
    return F.struct(score.alias("score"), F.when(score >= 70, "alta").when(score >= 45, "media").otherwise("baja").alias("band"), used.alias("llm_used"))


def needs_work(version: Column, title: Column, text: Column, kinds: Column, stored: Column, expected: Column, known: Column, pictured: Column, reading: Column) -> Column:
    """Whether an article has to be completed: it was not yet, or its text, entities, evidence, picture or reading are wanting.

    kinds: kinds of its entities; stored, expected, known: addresses of its evidence, of that which its diseases ask for, of all there is in the list.
    """
    text, title, reading = (F.trim(F.coalesce(x, F.lit(""))) for x in (text, title, reading))
    kinds = F.transform(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: F.upper(k))
    has = lambda *names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    stray = F.size(F.array_except(F.array_intersect(stored, known), expected)) > 0
    few = (F.size(expected) > 0) & (F.size(F.filter(stored, lambda s: F.array_contains(expected, s))) < F.least(F.lit(2), F.size(expected)))
    return (
        (F.coalesce(version, F.lit("")) != "ficha_v2") | (text == "") | (text == title) | (F.length(text) < 50) | ~has("ANIMAL") | ~has("ORG") | ~has("COUNTRY", "LOCATION")
        | stray | few | ~F.coalesce(pictured, F.lit(False)) | (F.length(reading) < 80) | F.contains(F.lower(reading), F.lit("solapamiento"))
    )


def exported(images: DataFrame, order: str, known: DataFrame) -> DataFrame:
    """Samples of pictures that can teach (image_id, class, confidence, sha256, storage_key, source_url, synthetic, width, height) and whose digest no sample has yet: the first picture by order of each digest, each one without a digest."""
    name = F.regexp_extract(F.replace("storage_key", F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)
    ending = F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))
    good = images.where(pictures.can_teach(F.col("class"), F.col("confidence"), F.col("storage_key"), F.col("source_url"), F.col("synthetic"), F.col("width"), F.col("height"))).withColumn("sha", F.nullif(F.trim("sha256"), F.lit("")))
    fresh = good.where("sha is not null").join(known.select(F.col("sha256").alias("sha")).distinct(), "sha", "left_anti").select(*good.columns)
    first = fresh.groupBy("sha").agg(F.min_by(F.struct(*[c for c in good.columns if c != "sha"]), order).alias("r")).select("r.*", "sha").select(*good.columns)
    rows = first.unionByName(good.where("sha is null"))
    file = F.concat(F.coalesce("sha", F.regexp_replace(name, r"\.[^.]*$", "")), ending)
    digest = F.coalesce("sha", F.sha2(file, 256))
    label = F.trim("class")
    return rows.select(hashing.short_id("CNN-", 16, label, file).alias("sample_id"), "image_id", label.alias("class"), F.concat_ws("/", label, file).alias("path"), hashing.split_of(digest).alias("split"), F.col("confidence").try_cast("double").alias("confidence"))


def event_cards(pairs: DataFrame, key: str, page: str, claim: str, body: str, order: list, most: int = 4) -> DataFrame:
    """The passages of bulletins that speak of a claim's event: key, page, snippet, status, score, turn, at most `most` of a claim.

    pairs: each claim beside the pages its diseases name. A page counts if its best passage states the claim's facts in part or in whole or scores 3; in whole
    adds 5, in part 2; of equal scores the first by order.
    """
    from marisma.functions import text
    from marisma.operators import reviews

    best = reviews.paragraphs(pairs, [key, page], claim, body)
    rows = pairs.join(best, [key, page], "left").withColumn("snippet", F.coalesce("paragraph", F.substring(F.trim(F.coalesce(body, F.lit(""))), 1, 500)))
    rows = text.once(rows, c=facts.compare(facts.extract(F.col(claim)), facts.extract(F.col("snippet"))))
    points = F.coalesce("score", F.lit(0))
    rows = rows.where(F.col("c.status").isin("hit", "partial") | (points >= 3)).withColumn("total", points + F.when(F.col("c.status") == "hit", 5).when(F.col("c.status") == "partial", 2).otherwise(0))
    top = facets.top_per_group(rows.select(key, page, F.substring("snippet", 1, 900).alias("snippet"), F.col("c.status").alias("status"), F.col("total").cast("int").alias("score"), *order), [key], [F.desc("score"), *[F.col(o) for o in order]], most)
    return top.select(key, page, "snippet", "status", "score", "turn")
