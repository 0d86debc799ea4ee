"""Names in texts, looked for by an automaton that is built from the rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.session import shared_checkpoints, ship

#: Characters of the terms that one automaton holds, and of those that the driver sees at once. Of a larger table terms that are one word each are joined with the words of the texts; the others are cut by their first letters and each part has its own.
LIMIT = 1 << 20
#: Rows found that a task holds before it gives them on.
HELD = 50_000
#: Characters of texts whose places a task of spans() holds before it gives them on.
PIECE = 1 << 20
#: Kinds of edges whose terms are joined; terms with rarer ones are left to automata.
EDGES = 8
# Letters that may not stand beside a term that is a word of its own; terms of at most so many characters always are.
WORD = "a-z0-9"
SHORT = 4
TERMS = "term string, canonical string, kind string, edge string"


@lru_cache(4)
def _automaton(shared: Broadcast) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    held: dict[str, list[tuple[str, str, str | None]]] = {}
    for term, canonical, kind, edge in shared.value:
        held.setdefault(term, []).append((canonical, kind, edge))
    for term, names in held.items():
        out.add_word(term, (len(term), names))
    if held:
        out.make_automaton()
    return out


@lru_cache(64)
def _beside(edge: str):
    import re

    return re.compile(f"[{edge}]")


def _hits(automaton: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int, str, str]]:
    """Every place of every term: first and last character (the latter excluded), canonical name, kind."""
    for last, (length, names) in automaton.iter(text):
        at, till = last - length + 1, last + 1
        for canonical, kind, edge in names:
            if edge and (at and _beside(edge).match(text[at - 1]) or till < len(text) and _beside(edge).match(text[till])):
                continue
            yield at, till, canonical, kind


def terms_of(table: DataFrame, canonical: str, kind: str | Column, variants: str, word: bool = False) -> DataFrame:
    """Rows of terms from a table of names and their variants (an array): the name itself and each variant, in lower case.

    Terms of up to SHORT characters, all with `word`, must stand as words of their own. A term that two names share keeps both.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    rows = table.select(F.explode(F.array_union(F.array(F.lower(F.col(canonical))), F.transform(F.coalesce(variants, F.array().cast("array<string>")), lambda v: F.lower(v)))).alias("term"), F.col(canonical).alias("canonical"), kind.alias("kind"))
    rows = rows.withColumn("term", F.trim("term")).where("term <> ''").distinct()
    return rows.withColumn("edge", F.when(F.lit(word) | (F.length("term") <= SHORT), F.lit(WORD)))


def _parts(terms: DataFrame, limit: int) -> list[DataFrame]:
    """terms, or parts of it of at most `limit` characters: terms with some first letters. One row for each first letter is looked at."""
    whole = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    if whole <= limit:
        return [terms]
    out, open_, letters = [], [("", None)], 1
    while open_:
        split = []
        for start, _ in open_:
            sizes = terms.where(F.col("term").startswith(start)).groupBy(F.substring("term", 1, letters).alias("s")).agg(F.sum(F.length("term")).alias("n"), F.max(F.length("term")).alias("most")).collect()
            bin_, size = [], 0
            for r in sorted(sizes, key=lambda r: r["s"]):
                if r["n"] > limit and r["most"] >= letters + 1:
                    split.append((r["s"], r["n"]))
                    continue
                if bin_ and size + r["n"] > limit:
                    out.append(terms.where(F.substring("term", 1, letters).isin(*bin_) & F.col("term").startswith(start)))
                    bin_, size = [], 0
                bin_.append(r["s"])
                size += r["n"]
            if bin_:
                out.append(terms.where(F.substring("term", 1, letters).isin(*bin_) & F.col("term").startswith(start)))
        open_, letters = split, letters + 1
    return out


def _share(terms: DataFrame) -> Broadcast:
    rows = [tuple(r) for r in terms.select("term", "canonical", "kind", "edge").where("term <> ''").collect()]
    return terms.sparkSession.sparkContext.broadcast(rows)


def _told(batches: Iterator[pa.RecordBatch], of: Callable[[str], list[tuple]], names: list[str], types: tuple) -> Iterator[pa.RecordBatch]:
    """What `of` finds in each text (the third column), beside the first two columns; in batches of about HELD rows."""
    for batch in batches:
        whose, found = [], []
        for i, t in enumerate(batch.column(2)):
            own = of(t.as_py()) if t.is_valid else []
            whose += [i] * len(own)
            found += own
            if len(found) >= HELD or i == len(batch) - 1:
                cells = [pa.array([f[j] for f in found], k) for j, k in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).take(pa.array(whose, pa.int64())).columns, *cells], names)
                whose, found = [], []


def _named_words(rows: DataFrame, key: str, words: DataFrame, edges: list[str]) -> DataFrame:
    """key, _text, kind, canonical, at, n for terms that are words: stretches of letters of their edge that no such letter extends, joined by equality."""
    schema = T.StructType([rows.schema[key], rows.schema["_text"], *T._parse_datatype_string("_edge int, _term string, at int, n int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        stretches = [re.compile(f"[{e}]+") for e in edges]

        def words(t: str) -> list[tuple]:
            out: list[tuple] = []
            for e, stretch in enumerate(stretches):
                own: dict[str, list[int]] = {}
                for m in stretch.finditer(t):
                    own.setdefault(m.group(), [m.start(), 0])[1] += 1
                out += [(e, w, *v) for w, v in own.items()]
            return out

        return _told(batches, words, schema.fieldNames(), (pa.int32(), pa.string(), pa.int32(), pa.int32()))

    number = F.array_position(F.array(*map(F.lit, edges)), F.col("edge")).cast("int") - 1
    named = words.select(number.alias("_edge"), F.col("term").alias("_term"), "kind", "canonical")
    found = rows.mapInArrow(run, schema).join(named, ["_edge", "_term"])
    return found.groupBy(key, "_text", "kind", "canonical").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"))


def mentions(docs: DataFrame, key: str, text: Column, terms: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each document, kind and canonical name found: key, kind, canonical, at (its first place in the lower-cased text), n (places).

    terms has term (lower case), canonical, kind, edge (letters, as inside the brackets of a pattern, that may not stand beside the term; null where it counts inside words too). Each
    task reads its texts once with an automaton, whose cost does not depend on the number of terms; nothing is exchanged. The automaton is
    built on the executors from shared rows whose size is checked. Of a table beyond `limit` characters, terms made of letters of their edge alone can only be whole
    words of a text, so they are joined with its words and never leave the executors; other terms, if still beyond it, are cut by first letters, and the texts are read once for each part.
    Rows with a null text, and those without a hit, give no row; a key that stands twice with different texts gives the rows of both.
    """
    spark = docs.sparkSession
    ship(spark)
    shared_checkpoints(spark)
    kind = docs.schema[key].dataType
    lower = F.lower(text)
    # rows of one key are told apart by their texts, in every reading alike
    rows = docs.select(F.col(key), F.xxhash64(lower).alias("_text"), lower.alias("_lower"))
    schema = T.StructType([T.StructField(key, kind), T.StructField("_text", T.LongType()), *T._parse_datatype_string("kind string, canonical string, at int, n int").fields])
    terms = terms.where("term <> ''").select("term", "canonical", "kind", "edge").checkpoint()

    def read(part: DataFrame) -> DataFrame:
        shared = _share(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared)

            def names(t: str) -> list[tuple]:
                own: dict[tuple[str, str], list[int]] = {}
                for at, _, canonical, name in _hits(automaton, t) if len(automaton) else ():
                    cell = own.setdefault((name, canonical), [at, 0])
                    cell[0] = min(cell[0], at)
                    cell[1] += 1
                return [(*k, *v) for k, v in own.items()]

            return _told(batches, names, schema.fieldNames(), (pa.string(), pa.string(), pa.int32(), pa.int32()))

        return rows.mapInArrow(run, schema)

    out, apart = [], True
    if (terms.agg(F.sum(F.length("term"))).first()[0] or 0) > limit:
        own = F.coalesce(F.rlike("term", F.concat(F.lit("^["), "edge", F.lit("]+\\z"))), F.lit(False))
        edges = [r["edge"] for r in terms.where(own).groupBy("edge").count().orderBy(F.desc("count"), "edge").limit(EDGES).collect()]
        if edges:
            own &= F.coalesce(F.col("edge").isin(*edges), F.lit(False))
            words, terms = terms.where(own), terms.where(~own)
            out.append(_named_words(rows, key, words, edges))
            apart = terms.select("kind", "canonical").intersect(words.select("kind", "canonical")).isEmpty()
    parts = [] if out and terms.isEmpty() else _parts(terms, limit)
    out += [read(p) for p in parts]
    whole = out[0]
    for other in out[1:]:
        whole = whole.union(other)
    if len(parts) > 1 or not apart:  # a name whose variants lie in several parts
        whole = whole.groupBy(key, "_text", "kind", "canonical").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"))
    return whole.drop("_text")


def entities(found: DataFrame, key: str) -> DataFrame:
    """Entities of documents: key, entity_id, kind, value; the id is made of kind and value alone."""
    mark = F.substring(F.sha2(F.concat_ws(":", "kind", "canonical"), 256), 1, 12)
    return found.select(key, F.concat(F.lit("ENT-"), mark).alias("entity_id"), "kind", F.col("canonical").alias("value")).distinct()


def spans(rows: DataFrame, text: Column, terms: Iterable[tuple[str, str, str, str | None]], name: str = "found", keep: Sequence[str] | None = None) -> DataFrame:
    """rows with all places of a small list of terms (term, canonical, kind, edge) in the lower-cased text: array<struct<at, till, canonical, kind>>, by place.

    The list is part of the plan, so its size is checked; a table of terms goes to mentions(). Of rows only the columns in `keep` go to Python and back, all where it
    is None: a text that is looked through need not be carried beside itself. A batch is read in stretches of about PIECE characters.
    """
    terms = [tuple(t) for t in terms]
    if sum(len(t[0]) for t in terms) > 1 << 16:
        raise ValueError("too many terms for a list; use mentions()")
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(terms)
    cell = pa.struct([("at", pa.int32()), ("till", pa.int32()), ("canonical", pa.string()), ("kind", pa.string())])
    rows = rows.select(*(rows.columns if keep is None else keep), F.lower(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string(f"{name} array<struct<at: int, till: int, canonical: string, kind: string>>").fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared)
        for batch in batches:
            texts, begin, read, size, flat = batch.column(batch.num_columns - 1), 0, 0, [], []
            for i, x in enumerate(texts, 1):
                t = x.as_py()
                own = sorted(_hits(automaton, t)) if t and len(automaton) else []
                size.append(len(own))
                flat += own
                read += len(t or "")
                if read >= PIECE or i == len(texts):
                    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    values = pa.StructArray.from_arrays([pa.array([f[j] for f in flat], cell.field(j).type) for j in range(4)], fields=list(cell))
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, i - begin).columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), values)], names)
                    begin, read, size, flat = i, 0, [], []

    return rows.mapInArrow(run, schema)
