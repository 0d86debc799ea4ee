"""Text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCENTED, PLAIN = "áéíóúüñàâäèêëìîïòôöùûçãõ", "aeiouunaaaeeeiiiooouucao"
# Words that mark how a sentence is meant, in the order they are tried.
NEGATION = r"(?i)\b(no existe evidencia|no hay evidencia|no se ocult|niega que|desmiente|no es cierto)\b"
QUOTE = r"(?i)\b(acusa|acusan|según|afirman que|usuarios afirman|la oposición|algunos usuarios|se dice que)\b"
DESCRIPTION = r"(?i)\b(analiza|investiga|estudio|investigación analiza)\b"
HYPOTHESIS = r"(?i)\b(podría|podrian|tal vez|quizá|quiza|hipótesis|especula)\b"
OPINION = r"(?i)^(creo que|parece que|en mi opinión)"
# First words that tell a predicate.
PREDICATES = ((r"(?i)\bocult", "OCULTA"), (r"(?i)\b(confirm|report|detect|anuncia|declara)", "REPORTA"), (r"(?i)\b(causa|provoca|produce)", "CAUSA"), (r"(?i)\b(niega|desmiente)", "NIEGA"), (r"(?i)\b(vacun)", "VACUNA"), (r"(?i)\b(brote|outbreak)", "BROTE_EN"))


def collapse(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"[\s ]+", " "))


def bare(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")


def strip_html(x: Column) -> Column:
    return collapse(F.regexp_replace(x, "<[^>]+>", " "))


def normalise(x: Column) -> Column:
    """What text identity is taken of: lower case, collapsed white space."""
    return collapse(F.lower(x))


def fold_accents(x: Column) -> Column:
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def non_empty(x: Column) -> Column:
    """Null for null, empty and blank."""
    return F.nullif(F.trim(x), F.lit(""))


def sentences(x: Column) -> Column:
    """Sentences end at white space after . ! ? ¿ or at line ends."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?¿])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def ended(x: Column) -> Column:
    """Stretches up to and with each . ! or ?, trimmed; what stands after the last one is none. Linear in the text, also where it has no such mark."""
    return F.transform(F.filter(F.split(x, r"(?<=[.!?])"), lambda s: s.rlike("[.!?]$")), lambda s: F.trim(s))


def modality(s: Column) -> Column:
    """How a sentence is meant; the first test that holds decides."""
    low = F.lower(s)
    question = s.endswith("?") | s.startswith("¿") | low.startswith("qué ") | low.startswith("que ")
    return (
        F.when(F.coalesce(F.trim(s), F.lit("")) == "", "afirmacion").when(question, "pregunta").when(s.rlike(NEGATION), "negacion").when(s.rlike(QUOTE), "cita")
        .when(s.rlike(DESCRIPTION), "descripcion").when(s.rlike(HYPOTHESIS), "hipotesis").when(s.rlike(OPINION), "opinion").otherwise("afirmacion")
    )


def split_compound(s: Column, cut: str = r",\s+y\s+| y que ", shortest: int = 40, piece: int = 18, most: int = 8) -> Column:
    """A long sentence as its parts; the sentence itself if that gives fewer than two parts of `piece` characters."""
    whole = collapse(s)
    parts = F.filter(F.transform(F.split(whole, cut), lambda p: F.btrim(p, F.lit(" ,.;"))), lambda p: F.length(p) >= piece)
    return F.when(F.length(whole) < shortest, F.array(whole)).when(F.size(parts) < 2, F.array(whole)).otherwise(F.slice(parts, 1, most))


def tokens(x: Column, stop: Sequence[str] = ()) -> Column:
    """Distinct words of three characters or more, without stop words and plain numbers."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-záéíóúñ0-9]{3,})"), 1))
    found = F.filter(found, lambda t: ~t.rlike("^[0-9]+$"))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def overlap_share(a: Column, b: Column, shortest: int = 5) -> Column:
    """Share of a's tokens (of at least `shortest` characters) that b has; 0 if there are none."""
    long_a, long_b = (F.filter(t, lambda w: F.length(w) >= shortest) for t in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(long_a, long_b)), F.size(long_a)), F.lit(0.0))


LETTERS = "a-z0-9áéíóúñ"


def quoted(term: str) -> str:
    """The term as a pattern that matches itself alone."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def has_word(x: Column, word: str, letters: str = LETTERS) -> Column:
    """Whether lower-cased x has word, taken literally, with no letter before or after it."""
    return F.lower(x).rlike(f"(^|[^{letters}]){quoted(word.lower())}([^{letters}]|$)")


def _tree(terms: Sequence[str]) -> str:
    """A pattern of the terms that shares their beginnings; longer terms are tried first."""
    rest: dict[str, list[str]] = {}
    for t in sorted(set(terms)):
        if t:
            rest.setdefault(t[0], []).append(t[1:])
    branches = "|".join(quoted(c) + _tree(tails) for c, tails in rest.items())
    if not branches:
        return ""
    return f"(?:{branches})" + ("?" if "" in terms else "")


def found_terms(x: Column, terms: Sequence[str], letters: str | None = LETTERS) -> Column:
    """The longest of the terms that stands at each place of lower-cased x, in one pass; null where x is.

    With letters, no letter may stand before or after a term; without, terms are found inside words too. All terms of x are these
    and the ones that `implied` adds.
    """
    tree = _tree([t.lower() for t in terms])
    if not tree:
        return F.when(x.isNotNull(), F.array().cast("array<string>"))
    pattern = f"(?<![{letters}])(?=({tree})(?![{letters}]))" if letters else f"(?=({tree}))"
    return F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(1))


def implied(terms: Sequence[str], letters: str | None = LETTERS) -> dict[str, list[str]]:
    """For each term all terms that stand at its place where it does: itself and terms that it begins with."""
    low = sorted({t.lower() for t in terms})
    ends = re.compile(f"[{letters}]") if letters else None
    return {t: [s for s in low if t.startswith(s) and (s == t or ends is None or not ends.match(t[len(s)]))] for t in low}


def labels_of(x: Column, named: Mapping[str, Sequence[str]], letters: str | None = LETTERS) -> Column:
    """The names of which a term stands in x, in the order of `named`."""
    names, of = list(named), {}
    for i, name in enumerate(names):
        for t in named[name]:
            of.setdefault(t.lower(), []).append(i)
    table = {t: sorted({i for s in ts for i in of[s]}) for t, ts in implied(list(of), letters).items()}
    return F.transform(numbers_of(found_terms(x, list(of), letters), table), lambda i: F.element_at(F.array(*[F.lit(n) for n in names]), i + 1))


def numbers_of(found: Column, table: Mapping[str, Sequence[int]]) -> Column:
    """Ordered distinct numbers of found terms."""
    by_term = F.create_map(*[c for t, numbers in table.items() for c in (F.lit(t), F.array(*[F.lit(i) for i in numbers]))])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda t: F.element_at(by_term, t)))))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row, however often they are used later.

    The optimizer copies an expression into every filter above it; it does not where a generator stands between.
    """
    return rows.select("*", F.explode_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_once")).select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col("_once")[k].alias(k) for k in columns])


def mask(x: Column, phrases: Sequence[str]) -> Column:
    """Lower-cased x with longer phrases blanked, so that a name inside them is not found."""
    out = F.lower(x)
    for p in phrases:
        out = F.replace(out, F.lit(p), F.lit(" "))
    return out


def predicate(s: Column) -> Column:
    out = F.lit("AFIRMA")
    for pattern, name in reversed(PREDICATES):
        out = F.when(s.rlike(pattern), name).otherwise(out)
    return out


def image_refs(html: Column) -> Column:
    """Images of a page, in order: array of struct(src, alt)."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<img\b[^>]*>)"), 1)
    refs = F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r"""(?i)\bsrc=["']([^"']*)["']""", 1).alias("src"), F.regexp_extract(t, r"""(?i)\balt=["']([^"']*)["']""", 1).alias("alt")))
    return F.filter(refs, lambda r: r["src"] != "")


def language_votes(x: Column, markers: dict[str, Sequence[str]], shortest: int = 12) -> Column:
    """The language with most markers in x (the first of equals); "und" without any or for a short text."""
    low = F.concat(F.lit(" "), F.lower(x), F.lit(" "))
    votes = {k: sum((F.when(F.contains(low, F.lit(m)), 1).otherwise(0) for m in words), F.lit(0)) for k, words in markers.items()}
    best = F.greatest(*votes.values()) if len(votes) > 1 else next(iter(votes.values()))
    out = F.lit("und")
    for k in reversed(list(votes)):
        out = F.when(votes[k] == best, k).otherwise(out)
    return F.when((F.length(x) < shortest) | x.isNull() | (best == 0), "und").otherwise(out)


def slug(x: Column) -> Column:
    return F.btrim(F.regexp_replace(fold_accents(x), "[^a-z0-9]+", "-"), F.lit("-"))


def escape_xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def excerpt(x: Column, most: int) -> Column:
    """At most `most` characters, cut at a space and marked where something is left out."""
    flat = collapse(x)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", ""), F.lit("…")))


def numbers(x: Column, units: str) -> Column:
    """Numbers that stand before one of the units, thousands marks removed, as array<bigint>."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), F.lower(x)), F.lit(rf"[^0-9](\d{{1,3}}(?:[.,]\d{{3}})+|\d+)\s*(?:{units})"), 1)
    return F.transform(found, lambda n: F.regexp_replace(n, "[.,]", "").try_cast("bigint"))
