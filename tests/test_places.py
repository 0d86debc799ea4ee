"""Names from a table and places in texts against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marisma.functions import geo
from marisma.operators import cards, gazetteer

TEXTS = [None, "", "the usa of gusano and Usa", "New Mexico and old mexico", "nuevo méxico", "baja california sur is not California", "presidio, texas; Peru/perú", "xx EE. UU. xx eeuux", "aa aaa aaaa", "ß ÉÉ é", "ab" * 5000]


def plain(texts, terms):
    out = {}
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for term, canonical, kind, edge in terms:
            for at in range(len(low) - len(term) + 1):
                if low.startswith(term, at) and not (edge and (at and re.match(f"[{edge}]", low[at - 1]) or re.match(f"[{edge}]", low[at + len(term) : at + len(term) + 1] or " "))):
                    first, n = out.get((i, kind, canonical), (at, 0))
                    out[i, kind, canonical] = (min(first, at), n + 1)
    return out


@pytest.mark.parametrize("limit", [1 << 20, 40, 7])
def test_mentions(spark, limit):
    """Also where the table is cut into many parts by first letters."""
    r = random.Random(3)
    terms = [("aa", "A", "x", None), ("aaa", "A", "x", "a-z"), ("ab", "B", "y", None), ("usa", "US", "COUNTRY", "a-z0-9"), ("mexico", "MX", "COUNTRY", None), ("é", "E", "x", "a-zé"), ("zz", "Z", "x", None)]
    terms += [("".join(r.choice("ab") for _ in range(r.randint(1, 5))), f"n{i % 7}", "r", r.choice([None, "a-z"])) for i in range(40)]
    terms = list(dict.fromkeys(terms))
    texts = TEXTS + ["".join(r.choice("ab c") for _ in range(60)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = gazetteer.mentions(df, "id", F.col("t"), spark.createDataFrame(terms, gazetteer.TERMS), limit).collect()
    assert {(x.id, x.kind, x.canonical): (x["at"], x.n) for x in got} == plain(texts, terms) and len(got) == len(plain(texts, terms))


def test_large_tables_stay_on_executors(spark, monkeypatch):
    """Terms that are words are joined: the driver never sees more than the rest of the table, and names of both kinds count once."""
    terms = [(f"w{i}", f"n{i % 9}", "ORG", "a-z0-9") for i in range(400)] + [(f"é{i}", f"n{i % 9}", "ORG", "a-zé0-9") for i in range(50)] + [("w7 ", "n7", "ORG", None), ("w3 x", "m", "ORG", "a-z0-9")]
    r = random.Random(8)
    texts = TEXTS + [r.choice([" ", "-", "é"]).join(r.choice(["w%d", "é%d", "xw%d", "w%d x", "W%d"]) % r.randrange(420) for _ in range(40)) for _ in range(60)]
    seen = []
    share = gazetteer._share
    monkeypatch.setattr(gazetteer, "_share", lambda t: (seen.append(t.count()), share(t))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = gazetteer.mentions(df, "id", F.col("t"), spark.createDataFrame(terms, gazetteer.TERMS), 100).collect()
    assert {(x.id, x.kind, x.canonical): (x["at"], x.n) for x in got} == plain(texts, terms) and len(got) == len(plain(texts, terms))
    assert sum(seen) == 2


def test_empty_tables(spark):
    terms = spark.createDataFrame([], gazetteer.TERMS)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    assert gazetteer.mentions(df, "id", F.col("t"), terms).count() == 0
    some = spark.createDataFrame([("a", "A", "x", None)], gazetteer.TERMS)
    assert gazetteer.mentions(df.limit(0), "id", F.col("t"), some).count() == 0
    with pytest.raises(ValueError):
        gazetteer.spans(df, F.col("t"), [("a" * 70_000, "A", "x", None)])


def test_terms(spark):
    table = spark.createDataFrame([("Bovino", ["Vaca", " res "]), ("FAO", None), ("Bovino", ["vaca", ""])], "name string, variants array<string>")
    got = gazetteer.terms_of(table, "name", "ANIMAL", "variants").collect()
    assert sorted((x.term, x.canonical, x.edge) for x in got) == [("bovino", "Bovino", None), ("fao", "FAO", "a-z0-9"), ("res", "Bovino", "a-z0-9"), ("vaca", "Bovino", "a-z0-9")]


def heard(text):
    blob, out = text.lower(), set()
    for n in {*(w for p in geo.PLACES for w in p[5]), *(a for a, _ in geo.ALIASES)}:
        masked = blob
        for phrase in geo.HIDES.get(n, ()):
            masked = masked.replace(phrase, " ")
        if n in masked if geo.edge(n) is None else re.search(f"(?<![{geo.LETTERS}]){re.escape(n)}(?![{geo.LETTERS}])", masked):
            out.add(n)
    return out


def test_places(spark):
    r = random.Random(5)
    names = [w for p in geo.PLACES for w in p[5]] + [a for a, _ in geo.ALIASES] + ["nothing", "gusano", "x"]
    texts = [t or "" for t in TEXTS] + [r.choice([" ", "", ", "]).join(r.choice(names) for _ in range(r.randint(0, 4))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, r.choice([None, "mx", "US-TX", "zz", "INT"])) for i, t in enumerate(texts)], "id int, t string, stored string")
    rows = gazetteer.spans(df, F.col("t"), geo.terms()).select("id", "stored", geo.heard(F.col("found")).alias("h"))
    for x in rows.select("*", geo.countries(F.col("h")).alias("cs"), geo.resolved(F.col("stored"), F.col("h")).alias("p")).collect():
        h = heard(texts[x.id])
        assert set(x.h) == h
        cs = list(dict.fromkeys(c for a, c in sorted(geo.ALIASES, key=lambda a: -len(a[0])) if a in h))
        place = next((p for p in geo.PLACES if h & set(p[5])), None)
        raw = (x.stored or "").upper()
        want = "US-TX" if raw == "US-TX" else place[0] if place else "MX" if raw == "MX" else (cs or ["XX"])[0]
        assert x.cs == cs and x.p.place_id == want and x.p.unlocated == (want in ("XX", "INT"))


def test_review_states(spark):
    articles = spark.createDataFrame([(i, "Insuficiente", 50) for i in range(6)], "id int, verdict string, risk int")
    log = [(0, 1, "validado", "a"), (1, 1, "descartado", "b"), (2, 1, "validado", "c"), (2, 2, " MODIFICADO", "d"), (3, 1, "modificado", "e"), (3, 2, "otro", None), (4, 1, None, "f"), (9, 1, "validado", "g")]
    reviews = spark.createDataFrame(log, "id int, turn int, label string, why string")
    got = {x.id: (x.verdict, x.risk, x.status, x.rule, x.hitl_reason, x.decisions, x.closed) for x in cards.review_states(articles, reviews, "id", "turn", "label", "why").collect()}
    assert got == {
        0: ("RESPALDADO", 22, "reviewed", "hitl_validado", "a", 1, 1), 1: ("CONTRADICHO", 82, "reviewed", "hitl_descartado", "b", 1, 1), 2: ("REVISIÓN HUMANA", 22, "pending_review", "hitl_modificado", "d", 2, 1),
        3: ("REVISIÓN HUMANA", 50, "reviewed", "hitl_modificado", "e", 2, 1), 4: ("Insuficiente", 50, "reviewed", None, None, 1, 1), 5: ("Insuficiente", 50, None, None, None, 0, 0),
    }


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_spans_in_stretches(spark, monkeypatch, piece):
    monkeypatch.setattr(gazetteer, "PIECE", piece)
    texts = ["texas y méxico", "", None, "nuevo méxico", "x" * 50, "usa, usa"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "id int, t string, stored string").coalesce(1)
    rows = gazetteer.spans(df, F.col("t"), geo.terms(), keep=["id"])
    assert rows.columns == ["id", "found"]
    assert {r.id: set(r.h) for r in rows.select("id", geo.heard(F.col("found")).alias("h")).collect()} == {i: heard(t or "") for i, t in enumerate(texts)}
    assert gazetteer.spans(df, F.col("t"), geo.terms()).columns == ["id", "t", "stored", "found"]
