"""Streams that break off and go on: two sinks, queues, peers."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marisma.operators import relations, stories
from marisma.streaming import batches, folders, mirror, queues

SCHEMA = "k string, i int, v string"


def land(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)


def stream(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def held(spark, path):
    return sorted((r.k or "", r.i) for r in folders.read(spark, path, spark.createDataFrame([], SCHEMA).schema).collect())


def test_two_sinks(spark, tmp_path):
    """The second write dies in the second batch and again at the restart; nothing is lost or doubled, and an empty mirror is filled."""
    at = f"file://{tmp_path}"
    land(spark, f"{at}/in", [("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), (None, 4, "n")])
    land(spark, f"{at}/in", [("b", 5, "x"), ("c", 6, "y"), (None, 7, "n")])
    land(spark, f"{at}/in", [("d", 8, "x"), ("c", 9, "y")])
    deaths = [1, 1]

    def dies(rows, path, number):
        if path.endswith("mirror") and number == 1 and deaths:
            deaths.pop()
            raise RuntimeError("the mirror is away")
        folders.write(rows, path, number)

    def run(name="mirror", sink=dies, checkpoint="check", store="store"):
        mirror.mirrored(stream(spark, f"{at}/in"), "k", "i", f"{at}/{store}", f"{at}/{name}", f"{at}/{checkpoint}", f"{at}/audit", sink).awaitTermination()

    for _ in range(2):
        with pytest.raises(Exception, match="the mirror is away"):
            run()
        assert folders.batches(spark, f"{at}/mirror") == [-1, 0] and folders.batches(spark, f"{at}/store") == [0, 1]
    run()
    want = [("", 4), ("", 7), ("a", 1), ("b", 3), ("c", 6), ("d", 8)]
    assert held(spark, f"{at}/store") == held(spark, f"{at}/mirror") == want
    log = spark.read.parquet(f"{at}/audit").orderBy("number").collect()
    assert [(r.number, r.stored) for r in log] == [(0, 3), (1, 2), (2, 1)]
    # another mirror, empty: it gets what was there before
    land(spark, f"{at}/in", [("e", 10, "x"), ("a", 11, "y")])
    run("late mirror")
    assert held(spark, f"{at}/late mirror") == held(spark, f"{at}/store") == [*want, ("e", 10)]
    assert folders.batches(spark, f"{at}/late mirror") == [-1, 3]


def test_dedup_repeats(spark, tmp_path):
    """A batch that is repeated as a whole leaves what it left before, null keys included."""
    at = f"file://{tmp_path}"
    land(spark, f"{at}/in", [("a", 1, "x"), (None, 2, "y")])
    for check in ("one", "two"):  # a lost checkpoint begins at batch 0 again
        batches.dedup_batches(stream(spark, f"{at}/in"), "k", "i", f"{at}/out", f"{at}/{check}")
        assert held(spark, f"{at}/out") == [("", 2), ("a", 1)]


def test_queue(spark, tmp_path):
    root, schema = f"file://{tmp_path}/queues", StructType([StructField("id", LongType()), StructField("text", StringType())])
    assert queues.drain(spark, root, "nlp", schema, lambda m: m) == 0 and queues.size(spark, root, "nlp") == 0
    with pytest.raises(ValueError):
        queues.enqueue(spark.range(1), root, "unknown")
    for first in (0, 100):
        queues.enqueue(spark.range(first, first + 30).select("id", F.lit("t").alias("text")).coalesce(1), root, "nlp", most=20)
        time.sleep(1.1)
    spark.createDataFrame([("{broken",), ("[1]",), ('{"id": "x", "text": 3}',), ('{"id": 7}',)], "value string").coalesce(1).write.text(f"{root}/nlp/messages/other")
    assert queues.size(spark, root, "nlp") == 64
    broken = [True]

    def handler(m):
        if broken:
            broken.clear()
            raise RuntimeError("worker died")
        return m.withColumn("length", F.length("text"))

    with pytest.raises(Exception, match="worker died"):
        queues.drain(spark, root, "nlp", schema, handler)
    assert queues.size(spark, root, "nlp") == 64
    taken = []
    while n := queues.drain(spark, root, "nlp", schema, handler):
        taken.append(n)
        assert queues.size(spark, root, "nlp") == 64 - sum(taken)
    assert sum(taken) == 64 and max(taken) <= 20
    out = spark.read.parquet(f"{root}/nlp/done").collect()
    assert sorted(r.id for r in out) == sorted([*range(30), *range(100, 130), 7])
    order = [min(r.id for r in out if r.batch == b) for b in sorted({r.batch for r in out})]
    assert [x >= 100 for x in order[:4]] == [False, False, True, True]  # oldest files first
    assert sorted(r.value for r in spark.read.parquet(f"{root}/nlp/poison").collect()) == ["[1]", '{"id": "x", "text": 3}', "{broken"]


def articles(n, seed):
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.1 else datetime.date(2026, 1, 1) + datetime.timedelta(r.randrange(30))
    return [(i, r.choice(["MX", "us", "", None, "XX", "US"]), r.sample(["a", "b", "c"], r.randrange(3)), day()) for i in range(n)]


def test_peers_of_articles(spark):
    """Against every pair, in a group larger than what one anchor keeps."""
    rows = articles(300, 1)
    df = spark.createDataFrame(rows, "id int, country string, tags array<string>, day date")
    got = {}
    for x in stories.peers(df.where("id % 3 = 0"), df, "id", "country", "tags", "day", days=3, most=5).orderBy("anchor", "turn").collect():
        got.setdefault(x.anchor, []).append(x.peer)
    code = lambda c: (c or "").upper()
    for i, c, t, d in rows[::3]:
        fits = [(d2, j) for j, c2, t2, d2 in rows if j != i and (code(c) in stories.NOWHERE or code(c) == code(c2)) and (not t or not t2 or set(t) & set(t2)) and (d is None or d2 is None or abs((d - d2).days) <= 3)]
        fits.sort(key=lambda x: (x[0] is None, -(x[0] or datetime.date.min).toordinal(), x[1]))
        assert got.get(i, []) == [j for _, j in fits[:5]]


def test_peers_in_time(spark):
    r = random.Random(2)
    rows = [(i, r.choice("xy") if i % 17 else None, datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=r.randrange(4000) * 30)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g string, ts timestamp")
    got = {}
    for x in relations.peers(df.where("id % 5 = 0"), df, "g", "ts", "id", 7, 6).orderBy("anchor", "turn").collect():
        got.setdefault(x.anchor, []).append(x.peer)
    for i, g, t in rows[::5]:
        fits = sorted((-u.timestamp(), j) for j, h, u in rows if j != i and g is not None and h == g and abs((u - t).total_seconds()) <= 7 * 86400)
        assert got.get(i, []) == [j for _, j in fits[:6]]


def test_peers_of_a_stream(spark, tmp_path):
    """Anchors that come in batches have the peers that all have at once."""
    at, schema = f"file://{tmp_path}", "id int, country string, tags array<string>, day date"
    rows = articles(120, 3)
    df = spark.createDataFrame(rows, schema)
    for i in range(3):
        land(spark, f"{at}/in", rows[i * 20 : i * 20 + 20], schema)
    near = lambda a: stories.peers(a, df, "id", "country", "tags", "day")
    batches.peer_batches(stream(spark, f"{at}/in", schema), near, f"{at}/out", f"{at}/check")
    want = sorted(map(tuple, near(df.where("id < 60")).collect()))
    assert sorted(tuple(r)[:3] for r in spark.read.parquet(f"{at}/out").select("anchor", "peer", "turn").collect()) == want
