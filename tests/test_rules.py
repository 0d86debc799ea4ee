"""Rules on null and empty fields, and on empty tables."""

import pytest
from pyspark.sql import functions as F

from marisma.functions import pictures, prose
from marisma.operators import assessment, catalog, intake, payloads


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_addresses(spark):
    null = F.lit(None).cast("string")
    r = one(spark, a=pictures.is_fake(null), b=pictures.public_url(null), c=pictures.stored_url(null), d=pictures.is_news_picture(null, null, null, null), e=pictures.is_generic(null, null), f=pictures.is_placeholder(null, null, F.lit(None).cast("boolean"), F.lit(None).cast("int"), F.lit(1)), g=pictures.hex_distance(null, F.lit("ab")), h=pictures.hex_distance(F.lit("abc"), F.lit("axc")))
    assert tuple(r) == (False, "", "", False, True, True, None, 1)
    assert one(spark, a=pictures.public_url(F.lit(" https://a.who.int/x ")), b=pictures.stored_url(F.lit("http://b.net")), c=pictures.hostname(F.lit("https://u:p@B.net.:8080/x"))) == ("https://a.who.int/x", "http://b.net", "b.net")


def test_sources(spark):
    null = F.lit(None).cast("string")
    grade = assessment.authority(null, null, null, null)
    r = one(spark, g=grade, u=assessment.unreliability(grade, null, null, null, F.lit(None).cast("int")), o=assessment.official_row(null, null, F.lit(55.0)), e=assessment.official_evidence(null, null, null, null), s=assessment.official_source(null, null, null, null))
    assert tuple(r) == ("", 55.0, False, False, False)
    assert one(spark, a=catalog.access(null, null), b=catalog.language(null, null), c=catalog.first_domain(F.array().cast("array<string>"), F.array(F.lit("A.net/x"))), d=intake.way(null, null, null, null), e=intake.minutes(F.lit(None).cast("int"), null)) == ("scrape", "und", "a.net", "scrape", 60)


def test_prose(spark):
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    r = one(spark, a=prose.reading(null, null, F.lit(None).cast("int"), none, none, none, none, null), b=prose.card_excerpt(null, null), c=prose.risk_tone(F.lit(None).cast("int")), d=prose.country_from_text(null), e=prose.source_id_for(null, null), f=prose.source_name(null, null, null, null), g=prose.severity_part(none, none, F.lit(0)))
    assert r.a.startswith("Lectura del caso «este documento»: se clasifica como Sin verificar con riesgo no calculado.") and tuple(r)[1:] == ("", "mid", "INT", "SRC-CORPUS", "Fuente", "No hay afirmación estructurada → 0.")


def test_empty_tables(spark):
    claims = spark.createDataFrame([], "doc_id int, kind string, predicate string, verifiable boolean, label string")
    assert assessment.severity(claims, "doc_id", "kind", "predicate", "verifiable").count() == 0 and assessment.labels(claims, "doc_id", "label").count() == 0
    assert [r.n for r in assessment.stances(claims, "doc_id", "label").collect()] == [0, 0, 0]
    articles = spark.createDataFrame([(1, "Unknown", 80, False)], "doc_id int, nli string, severity int, official boolean")
    peers = spark.createDataFrame([], "doc_id int, verdict string, official boolean")
    assert tuple(assessment.cross_cut(articles, "doc_id", peers).first()) == (1, 0.0, "", 0)
    images = spark.createDataFrame([], "image_id int, class string, confidence double, storage_key string, source_url string, synthetic boolean, width int, height int, sha256 string")
    assert assessment.exported(images, "image_id", spark.createDataFrame([], "sha256 string")).count() == 0
    posts = spark.createDataFrame([(1, None, None, None), (2, " ", "x", 1), (3, "ok", None, None)], "id int, content string, url string, created int")
    assert [tuple(r)[:3] for r in intake.imported_posts(posts, "id").collect()] == [(3, "social", "inapp:social/3")]
    keys = spark.createDataFrame([("a",), (None,)], "k string")
    assert sorted((r.k or "", r.there) for r in intake.present(keys, "k", keys, keys.limit(0)).collect()) == [("", False), ("a", True)]
    assert payloads.one(rows=keys.limit(0)).first().rows == []
    with pytest.raises(Exception):
        intake.mirrored(keys, keys, "unknown", "k", "k")
