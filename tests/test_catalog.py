"""Numbers of rows, perceptual hashes, ties by first appearance, narratives of empty tables."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from marisma.operators import lexicon, numbering, series, surveillance
from marisma.sources import files


def test_numbered(spark):
    """Dense, in order over many ranges, and no window over the whole table."""
    r = random.Random(1)
    rows = [(i, r.randrange(50) if i % 9 else None) for i in range(2000)]
    out = numbering.numbered(spark.createDataFrame(rows, "id int, n int").repartition(7), [F.col("n").asc_nulls_last(), F.col("id")], "place")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((x.place, x.id) for x in out.collect())
    assert got == list(enumerate([i for i, n in sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[0]))], 1))
    assert numbering.numbered(spark.createDataFrame([], "id int"), [F.col("id")], "place").count() == 0


def plain_hash(pixels, size):
    """By the sums of the definition."""
    n = 2 * size

    def dct(v):
        out = [sum(v[i] * math.cos((2 * i + 1) * k * math.pi / (2 * n)) for i in range(n)) * math.sqrt(2 / n) for k in range(n)]
        out[0] /= math.sqrt(2)
        return out

    rows = [dct(row) for row in pixels]
    both = list(zip(*[dct(col) for col in zip(*rows, strict=True)], strict=True))
    low = [v for row in both[:size] for v in row[:size]]
    low[0] = float(np.median(low))
    middle = float(np.median(low))
    return f"{int(''.join('1' if v > middle else '0' for v in low), 2):0{size * size // 4}x}"


def test_wave_hash(spark):
    r = np.random.default_rng(7)
    pictures = [r.integers(0, 256, (32, 32)).astype(np.uint8) for _ in range(6)]
    df = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(pictures)] + [(90, bytearray(b"abc")), (91, None)], "id int, b binary")
    got = {x.id: x.h for x in df.select("id", files.wave_hash(F.col("b")).alias("h")).collect()}
    assert got[90] is None and got[91] is None
    assert all(got[i] == plain_hash(p.astype(float).tolist(), 16) for i, p in enumerate(pictures))
    assert files.wave_hashes(pictures[0][None, :16, :16].astype(float), 8) == [plain_hash(pictures[0][:16, :16].astype(float).tolist(), 8)]


def test_first_inserted(spark):
    """As a counter that is filled in order of document, sentence and hit."""
    terms = [("b", "x", 1), ("a", "x", 1), ("d", "y", 2), ("c", "y", 2)]
    r = random.Random(4)
    docs = [(i, ". ".join(" ".join(r.sample("abcdez", 3)) for _ in range(4)) + ".") for i in range(12)]
    found = lexicon.sentence_hits(spark.createDataFrame(docs, "doc_id int, text string").repartition(3), "doc_id", terms)
    want = collections.Counter()
    for _, text in docs:
        for sentence in text.split(". "):
            for t, _, _ in terms:
                want[t] += t in sentence.strip(".").split()
    got = lexicon.most_common(lexicon.first_inserted(found, "doc_id"), 4).collect()
    seen = list(dict.fromkeys(t for _, text in docs for sentence in text.split(". ") for t, _, _ in terms if t in sentence.strip(".").split()))
    assert [(x.term, x.n) for x in got] == sorted(want.items(), key=lambda x: (-x[1], seen.index(x[0])))


def test_series_edges(spark):
    """90 days and 18 points are still days; one more of either makes months."""
    import datetime

    day = lambda i: datetime.date(2026, 1, 1) + datetime.timedelta(i)
    groups = {"span 90": [0, 90], "span 91": [0, 91], "points 18": range(18), "points 19": range(19)}
    df = spark.createDataFrame([(g, day(i), 1) for g, days in groups.items() for i in days], "g string, day date, n bigint")
    width = {(x.g, len(x.bucket)) for x in series.bucketed(df, "g", "day", "n").collect()}
    assert width == {("span 90", 10), ("span 91", 7), ("points 18", 10), ("points 19", 7)}
    assert series.aligned(df.limit(0), "g", "day", "n").count() == 0 and series.peak(series.aligned(df.limit(0), "g", "day", "n"), "g").count() == 0
    assert series.dominant_week(df.where("g = 'span 90'"), "day", "n").count() == 0


def test_narratives_of_little(spark):
    schema = "g string, k int, day date, country string, source string, name string"
    none = spark.createDataFrame([], schema)
    assert surveillance.characterize(none, "g", "k", "day", "country", "source", "name").count() == 0
    assert surveillance.kpis(surveillance.characterize(none, "g", "k", "day", "country", "source", "name")).first().narratives == 0
    one = spark.createDataFrame([("n", 5, None, "", None, "")], schema)
    got = surveillance.characterize(one, "g", "k", "day", "country", "source", "name").first()
    assert (got.volume, got.stage, got.country_n, got.sources_n, got.growth, got.series, got.articles) == (1, "origen", 0, 1, 100.0, None, [5]) and got.sources[0].source == "desconocida"


def test_pictures_and_patches(spark):
    import pytest

    from marisma.sinks import tables

    heads = {"image/jpeg": b"\xff\xd8\xff\xe0aaaa", "image/png": b"\x89PNG\r\n\x1a\nxx", "image/gif": b"GIF89a", "image/bmp": b"BMxx", "image/webp": b"RIFF\x01\x02\x03\x04WEBPVP8 ", None: b"RIFF\x01\x02\x03\x04WAVE"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()] + [(None, bytearray(b"")), (None, None)], "kind string, b binary")
    assert all(r.kind == r.found for r in df.select("kind", files.picture_kind(F.col("b")).alias("found")).collect())
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "z", None), (2, "z", 5), (3, "z", 6)], "k int, x string, y int")
    assert sorted(tuple(r) for r in tables.patched(old, new, ["k"], ["y"]).collect()) == [(1, "a", 1), (2, "b", 5)]
    with pytest.raises(ValueError):
        tables.patched(old, new, ["k"], ["unknown"])


def test_json_edges(spark):
    from marisma.functions import jsons

    rows = [(0, None), (1, ""), (2, "null"), (3, '"text"'), (4, "{}"), (5, '{"a": {"b": [1, 2]}} trailing'), (6, "```json\n{\"a\": 1}\n```"), (7, '``` {"a": 2'), (8, '{"a": "}"}'), (9, "x {1} y")]
    df = spark.createDataFrame(rows, "id int, x string")
    got = {r.id: r.v for r in df.select("id", F.to_json(jsons.salvaged(F.col("x"))).alias("v")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: "{}", 5: '{"a":{"b":[1,2]}}', 6: '{"a":1}', 7: None, 8: '{"a":"}"}', 9: None}
    best = df.where("id = 0").select(jsons.best(F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.lit(0.5), F.lit("c"), F.lit(None).cast("double"))).alias("b"), jsons.best(F.create_map().cast("map<string, double>")).alias("none")).first()
    assert best.b.label == "a" and best.none is None
