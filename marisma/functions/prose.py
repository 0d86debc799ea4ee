"""Sentences that are made of fields, and short forms of texts for cards, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marisma.functions import text, urls

# Words that tell a country in the order they are tried, noise of aggregators in excerpts, bounds of tones of risk.
COUNTRY_WORDS = (
    ("méxico", "MX"), ("mexico", "MX"), ("jalisco", "MX"), ("chiapas", "MX"), ("united states", "US"), ("estados unidos", "US"), ("guatemala", "GT"), ("brasil", "BR"), ("argentina", "AR"), ("colombia", "CO"), ("españa", "ES"), ("china", "CN"), ("woah", "INT"), ("fao", "INT"), ("who.int", "INT"),
)
NOISE = r"(?i)\b(avian influenza|h5n1|hpai|screwworm|senasica|woah|classical swine fever|gusano barrenador|gripe aviar)\b"
SHORTEST = 48
# What stands where a field has nothing.
NOTHING = {"disease": "salud animal", "animal": "especie no precisada", "country": "ámbito no determinado", "org": "WOAH, FAO", "source": "el observatorio", "verdict": "Sin verificar", "title": "este documento"}


def listed(values: Column, missing: str) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise(missing)


def _filled(x: Column, missing: str) -> Column:
    return F.coalesce(text.non_empty(x), F.lit(missing))


def reading(title: Column, verdict: Column, risk: Column, diseases: Column, animals: Column, countries: Column, orgs: Column, source: Column) -> Column:
    """How an article's case is read: verdict, risk and entities in a paragraph."""
    scored = F.when(risk.isNotNull(), F.concat(F.lit("riesgo "), risk.cast("string"), F.lit("/100"))).otherwise("riesgo no calculado")
    return F.concat(
        F.lit("Lectura del caso «"), _filled(title, NOTHING["title"]), F.lit("»: se clasifica como "), _filled(verdict, NOTHING["verdict"]), F.lit(" con "), scored, F.lit(". Enfermedad: "), listed(diseases, NOTHING["disease"]), F.lit(". Especie: "), listed(animals, NOTHING["animal"]),
        F.lit(". País o ámbito: "), listed(countries, NOTHING["country"]), F.lit(". Organizaciones de referencia: "), listed(orgs, NOTHING["org"]), F.lit(". Fuente: "), _filled(source, NOTHING["source"]),
        F.lit(". El párrafo se arma con entidades, veredicto y riesgo; no decide si el contenido es verdadero."),
    )


def summary(title: Column, source: Column, diseases: Column, words: Column, country: Column) -> Column:
    """What stands for the body of an article that has none: title, source and six words at most (of the title where there are none)."""
    own = F.slice(F.filter(F.split(F.trim(F.coalesce(title, F.lit(""))), r"\s+"), lambda w: F.length(w) > 3), 1, 6)
    six = F.slice(F.when(F.size(words) > 0, words).otherwise(own), 1, 6)
    return F.concat(
        F.lit("«"), _filled(title, "Documento sin título"), F.lit("» es un documento de "), _filled(source, "fuente del observatorio"), F.lit(" sobre "), listed(diseases, NOTHING["disease"]),
        F.lit(". No había cuerpo periodístico usable: el resumen se reconstruye con el título, la fuente y palabras clave ("), F.array_join(six, ", "), F.lit("). Ámbito geográfico: "), _filled(country, NOTHING["country"]), F.lit("."),
    )


def evidence_part(label: Column, value: Column, cut_score: Column, cut_peers: Column, cut_reason: Column) -> Column:
    """Why the part of evidence in a risk is what it is."""
    whole = lambda x: F.bround(x, 0).cast("bigint").cast("string")
    told = F.when(label == "Contradicted", "Choca con ficha oficial → 90.").when(label == "Supported", "Cuadra con ficha oficial → 10.").otherwise("Sin overlap suficiente con ficha oficial → 40 de base.")
    cut = F.when(cut_score > 0, F.concat(F.lit("Cruce con "), cut_peers.cast("string"), F.lit(" notas del mismo brote ("), _filled(cut_reason, "discrepancia"), F.lit(") → "), cut_score.cast("bigint").cast("string"), F.lit(".")))
    return F.concat_ws(" ", F.concat(F.lit("NLI de la afirmación: "), label, F.lit(".")), told, cut, F.concat(F.lit("Este parámetro toma el máximo de esas vías: "), whole(value), F.lit(".")))


def severity_part(kinds: Column, predicates: Column, value: Column) -> Column:
    """Why the part of claims is what it is, of distinct kinds and predicates in order."""
    found = F.when(F.size(predicates) > 0, F.concat(F.lit("; predicado "), F.array_join(predicates, ", "))).otherwise("")
    return F.when(F.size(kinds) <= 0, "No hay afirmación estructurada → 0.").otherwise(F.concat(F.lit("Patrón de afirmación: "), F.array_join(kinds, ", "), found, F.lit(" → "), value.cast("bigint").cast("string"), F.lit(" (conspiración/oculta=80, brote o cifra=45, no verificable=35, resto=15).")))


def card_excerpt(body: Column, title: Column, most: int = 180) -> Column:
    """A short cut of a text for a card: without its title at the beginning, addresses and the noise of aggregators; empty if too little is left."""
    raw, t = text.collapse(F.coalesce(body, F.lit(""))), text.collapse(F.coalesce(title, F.lit("")))
    begins = (t != "") & F.lower(raw).startswith(F.lower(t))
    raw = F.when(begins, F.regexp_replace(F.substring(raw, F.length(t) + 1, F.length(raw)), r"^[\s.:;,—-]+", "")).otherwise(raw)
    raw = F.regexp_replace(raw, r"(?i)^«[^»]+»\s*(es un documento[^.]*\.)?\s*", "")
    raw = F.regexp_replace(F.regexp_replace(raw, r"\b\d{8}T\d+\S*", " "), NOISE, " ")
    raw = text.collapse(F.regexp_replace(raw, r"(?i)\b[\w.-]+\.(com|org|net|gov|edu|mx)\b", " "))
    return F.when((F.length(raw) < SHORTEST) | (F.lower(raw) == F.lower(t)), "").when(F.length(raw) > most, F.concat(F.substring(raw, 1, most - 1), F.lit("…"))).otherwise(raw)


def source_name(url: Column, mapped: Column, kind: Column, source_id: Column) -> Column:
    """The name a source is shown by: its host, but for an aggregator's, else its listed name or kind where they are no ids, else its id."""
    host = F.when(url.rlike("^https?://"), urls.host(F.trim(url)))
    named = F.when(~mapped.startswith("SRC-"), text.non_empty(mapped))
    kind = F.when(~F.lower(kind).startswith("src-"), text.non_empty(kind))
    return F.coalesce(F.when((host != "") & ~F.contains(host, F.lit("gdeltproject.org")), host), named, kind, text.non_empty(mapped), source_id, F.lit("Fuente"))


def risk_tone(risk: Column) -> Column:
    return F.when(risk >= 70, "high").when((risk >= 40) | risk.isNull(), "mid").otherwise("low")


def country_from_text(x: Column) -> Column:
    """Code of the first word in the list that a text holds, as a part; INT without any."""
    low, out = F.lower(F.coalesce(x, F.lit(""))), F.lit("INT")
    for word, code in reversed(COUNTRY_WORDS):
        out = F.when(F.contains(low, F.lit(word)), code).otherwise(out)
    return out


def source_id_for(url: Column, raw_format: Column) -> Column:
    """SRC- and a short slug of the host, else of the format."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    named = F.replace(F.coalesce(F.nullif(host, F.lit("")), text.non_empty(raw_format), F.lit("corpus")), F.lit("www."), F.lit(""))
    slug = F.substring(F.btrim(F.regexp_replace(F.lower(named), "[^a-z0-9]+", "-"), F.lit("-")), 1, 28)
    return F.concat(F.lit("SRC-"), F.upper(F.when(slug == "", "corpus").otherwise(slug)))


def search_queries(diseases: Column, places: Column) -> Column:
    """What to look for: the first disease, where it is, among official bodies and checkers of facts."""
    core = F.concat(F.lit('"'), F.coalesce(F.get(diseases, F.lit(0)), F.lit("animal disease outbreak")), F.lit('"'))
    return F.array(F.concat(core, F.lit(" site:woah.org OR site:who.int OR site:cdc.gov OR site:fao.org")), F.concat_ws(" ", core, F.coalesce(F.get(places, F.lit(0)), F.lit("")), F.lit("official report")), F.concat(core, F.lit(" SENASICA OR WAHIS outbreak")), F.concat(core, F.lit(" fact check")))
