"""Text, date, address and score functions on small values."""

import pytest
from pyspark.sql import functions as F

from marisma.functions import dates, hashing, scoring, text, urls
from marisma.operators import filters


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_text_identity_ignores_case_and_space(spark):
    a, b, c = values(spark, text.normalise(F.col("x")), ["Hola  Mundo\n", " hola mundo", "hola, mundo"])
    assert a == b != c


def test_modality(spark):
    got = values(spark, text.modality(F.col("x")), ["¿Hay brote?", "que pasa", "No hay evidencia de eso.", "Según la nota, sí.", "Un estudio mide esto.", "Tal vez llueva.", "Creo que no.", "Llueve.", ""])
    assert got == ["pregunta", "pregunta", "negacion", "cita", "descripcion", "hipotesis", "opinion", "afirmacion", "afirmacion"]


def test_sentences_and_parts(spark):
    assert values(spark, text.sentences(F.col("x")), ["Uno. Dos! Tres?\ncuatro", "", None]) == [["Uno.", "Dos!", "Tres?", "cuatro"], [], None]
    long = "La autoridad informa del caso nuevo, y que los vecinos esperan otra respuesta"
    assert len(values(spark, text.split_compound(F.col("x"), cut=", y que "), [long])[0]) == 2


def test_word_bounds(spark):
    assert values(spark, text.has_word(F.col("x"), "rabia"), ["la rabia sube", "Arabia", "rabia"]) == [True, False, True]
    assert values(spark, text.has_word(text.mask(F.col("x"), ["new mexico"]), "mexico"), ["New Mexico", "en Mexico"]) == [False, True]


def test_dates(spark):
    got = values(spark, dates.parse_datetime(F.col("x")).cast("string"), ["20240105T101500Z", "2024-01-05T10:15:00+02:00", "Mon, 05 Jan 2024 10:15:00 GMT", "x", None])
    assert got == ["2024-01-05 00:00:00", "2024-01-05 08:15:00", "2024-01-05 10:15:00", None, None]


def test_urls(spark):
    assert values(spark, urls.canonical(F.col("x")), ["https://WWW.Example.org/a/b//?q=1", "nonsense", None]) == ["example.org/a/b", "", ""]
    assert values(spark, urls.suffixes(F.lit("a.b.org")), ["x"]) == [["a.b.org", "b.org", "org"]]
    assert values(spark, urls.under(urls.host(F.col("x")), urls.OFFICIAL), ["https://www.woah.org/x", "https://notwoah.org"]) == [True, False]


def test_weights_add_up():
    assert sum(scoring.WEIGHTS.values()) == pytest.approx(1)


def test_risk_and_verdict(spark):
    parts = {k: F.lit(100.0) for k in scoring.WEIGHTS}
    assert values(spark, scoring.weighted_risk(parts), ["x"]) == [100]
    s, n, h, low = F.col("s"), F.col("n"), F.col("h"), F.col("l")
    rows = [(80, "Unknown", False, False), (30, "Supported", False, False), (60, "Unknown", False, False), (10, "Unknown", False, False), (10, "Contradicted", False, False), (10, "Supported", True, False)]
    assert values(spark, scoring.verdict(s, n, h, low), rows, "s int, n string, h boolean, l boolean") == ["CONTRADICHO", "RESPALDADO", "POSIBLEMENTE ENGAÑOSO", "INSUFICIENTE", "CONTRADICHO", "REVISIÓN HUMANA"]
    assert values(spark, scoring.numeric_discrepancy(F.col("a"), F.col("b")), [(247, 12), (30, 12), (5, 4)], "a int, b int") == [86, 62, 0]


def test_hamming(spark):
    a, b = "0" * 64, "f" + "0" * 63
    assert values(spark, hashing.hamming_bits(F.col("a"), F.col("b")), [(a, a), (a, b)], "a string, b string") == [0, 4]


def test_query_parameters():
    q = filters.ArticleQuery.parse(lang=" ", size="9999", page="-3", text="a", limit=3)
    assert (q.lang, q.size, q.page, q.text) == (None, 400, 1, "a")
    assert filters.ArticleQuery.parse(limit=3).size == 3 and filters.ArticleQuery.parse(size="x").size == 12
