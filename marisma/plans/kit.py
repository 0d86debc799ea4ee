"""What registered queries share: tables, small lexicons of words that occur in the documents, SQL pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marisma.functions import text
from marisma.sources.tables import table

LETTERS = text.LETTERS
# Frequent words of four languages, and what animal health is written about.
_WORDS = {
    ("en", 2): "the and that for with this from are was not have which their been will would there what when your",
    ("fr", 2): "les des que dans pour une sur pas par est avec plus sont mais nous vous cette ces aux elle",
    ("de", 3): "der die und das den nicht von mit sich auf für eine auch als dem nach werden über noch oder",
    ("es", 1): "los del las con por para una como más pero sus este cuando muy sin sobre también entre hasta donde",
    ("enfermedad", 3): "brucelosis rabia influenza gripe ántrax triquinosis leptospirosis tuberculosis miasis newcastle aftosa fiebre",
    ("animal", 2): "aves ganado bovino porcino ovino equino gallinas cerdos vacas caballos cabras perros",
    ("lugar", 1): "méxico chiapas oaxaca texas yucatán durango sonora jalisco veracruz puebla españa francia",
    ("novedad", 1): "primer primera nuevo nueva inédito siglo first outbreak",
}
_PHRASES = {
    ("en", 3): "of the;in the;to the;and the;on the;for the", ("fr", 3): "de la;dans les;pour les;et les;sur les", ("de", 2): "in der;auf der;mit der;an der;aus der", ("es", 2): "de los;en los;por los;con los;a los",
    ("enfermedad", 5): "gripe aviar;peste porcina;gusano barrenador;fiebre aftosa;influenza aviar;avian influenza", ("lugar", 2): "nuevo méxico;estados unidos;new mexico;united states", ("novedad", 2): "primer caso;este siglo",
}
LEXICON = [(w, c, n) for (c, n), words in _WORDS.items() for w in words.split()] + [(t, c, n) for (c, n), terms in _PHRASES.items() for t in terms.split(";")]
STOP = ("the", "and", "for", "that", "with", "from", "this", "are", "was", "los", "las", "del", "por", "con", "para", "que")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def word_sql(x: str, term: str, letters: str = LETTERS) -> str:
    return f"regexp_matches({x}, '(^|[^{letters}]){text.quoted(term)}([^{letters}]|$)')"


def lexicon_sql() -> str:
    """Rows of the lexicon: pos, term, category, weight."""
    return "(values " + ", ".join(f"({i}, '{t}', '{c}', {w})" for i, (t, c, w) in enumerate(LEXICON)) + ") as lex(pos, term, category, weight)"


def hits_sql(source: str, key: str, column: str) -> str:
    """key, pos, term, category, weight: one row for each term that stands in a text."""
    tests = ", ".join(f"case when {word_sql('l', t)} then {i} end" for i, (t, _, _) in enumerate(LEXICON))
    found = f"select {key}, unnest(list_filter([{tests}], lambda i: i is not null)) as pos from (select {key}, lower({column}) as l from {source})"
    return f"select f.{key}, pos, lex.term, lex.category, lex.weight from ({found}) f join {lexicon_sql()} using (pos)"


#: Sentences of documents: doc_id, pos, s. DuckDB's patterns can't look behind, so a mark is put after the stop first.
SENTENCES = """select doc_id, row_number() over (partition by doc_id order by p) - 1 as pos, s from (
  select doc_id, unnest(range(len(parts))) as p, trim(unnest(parts)) as s from (
    select doc_id, string_split_regex(regexp_replace(text, '([.!?¿])[ \\t\\n\\r\\f\\x0b]+', '\\1' || chr(30), 'g'), chr(30) || '|\\n+') as parts from documents)) where s <> ''"""
COLLAPSE = "trim(regexp_replace({x}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\x0b\\x{{a0}}]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    stop = ", ".join(f"'{s}'" for s in STOP)
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '([a-záéíóúñ0-9]{{3,}})', 1)), lambda t: not regexp_matches(t, '^[0-9]+$') and not list_contains([{stop}], t))"
