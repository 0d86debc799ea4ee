"""Operators against plain versions of themselves."""

import random

from pyspark.sql import functions as F

from marisma.operators import dedup, facets, graph, narratives, relations
from marisma.sinks import tables
from marisma.sources import feeds, files
from marisma.streaming import batches


def test_cascade_is_greedy(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, *"abcdefgh"]), r.choice([None, *"uvwxyz"])) for i in range(60)]
    seen, kept = (set(), set()), []
    for i, u, t in rows:
        if (u is not None and u in seen[0]) or (t is not None and t in seen[1]):
            continue
        kept.append(i)
        seen[0].add(u)
        seen[1].add(t)
    df = spark.createDataFrame(rows, "i int, u string, t string")
    assert sorted(x.i for x in dedup.cascade(df, ["u", "t"], "i").collect()) == kept


def test_first_seen(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i int, k string")
    assert sorted(x.i for x in dedup.first_seen(df, "k", "i").collect()) == [1, 3, 4]


def test_dense_days(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-04",), ("2024-01-04",)], "d string").select(F.to_date("d").alias("day"))
    got = facets.dense_daily(df, "day").orderBy("day").collect()
    assert [(x.n, x.missing) for x in got] == [(1, False), (0, True), (0, True), (2, False)]
    assert facets.dense_daily(df.limit(0), "day").count() == 0


def test_lifecycle(spark):
    series = {"up": [1, 2, 3], "down": [1, 5, 2], "again": [1, 9, 2, 4], "flat": [3]}
    rows = [(k, i, n) for k, v in series.items() for i, n in enumerate(v)]
    got = {x.g: x.stage for x in narratives.lifecycle(spark.createDataFrame(rows, "g string, day int, n int"), "g", "day", "n").collect()}
    assert got == {"up": "crecimiento", "down": "descenso", "again": "recurrencia", "flat": "pico"}


def test_chunks_leave_the_rest_to_the_last(spark):
    df = spark.createDataFrame([("g", i) for i in range(13)], "g string, i int")
    got = narratives.chunks(df, "g", ["i"]).groupBy("chunk").count().orderBy("chunk").collect()
    assert [x["count"] for x in got] == [2, 2, 2, 2, 5]


def test_edges_are_symmetric(spark):
    df = spark.createDataFrame([("a", "b", "x", 2), ("b", "a", "y", 1), ("a", "a", "z", 0)], "a string, b string, l string, s int")
    assert [tuple(x) for x in graph.edges(df, "a", "b", "l", "s").collect()] == [("a", "b", 2, "y")]


def test_near_hashes(spark):
    rows = [(1, "0" * 64), (2, "1" + "0" * 63), (3, "f" * 64), (4, "0" * 63 + "7")]
    df = spark.createDataFrame(rows, "i int, h string")
    got = {(x.query, x.match) for x in relations.near_hashes(df, df, "i", "h", 95).collect()}
    assert got == {(a, b) for a in (1, 2, 4) for b in (1, 2, 4) if a != b}


def test_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    got = sorted(tuple(x) for x in tables.upsert(old, new, ["k"], ["v"]).collect())
    assert got == [(1, "a", 5), (2, "B", 6), (3, "C", None)]


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://x.org/1</link><description>&lt;b&gt;Hi&lt;/b&gt; you</description><pubDate>d</pubDate></item><item><title>no link</title></item></channel></rss>")
    got = feeds.rss_items(spark, f"file://{tmp_path}/f.xml").collect()
    assert [(x.title, x.link, x.text, x.published) for x in got] == [("A", "http://x.org/1", "Hi you", "d")]


def test_binary_files(spark, tmp_path):
    for k in ("cat", "dog"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "1.bin").write_bytes(bytes(range(256)) * 2)
    found = files.binary_files(spark, f"file://{tmp_path}")
    got = found.withColumn("hash", files.image_hash(F.col("content"))).collect()
    assert len(got) == 2 and got[0]["hash"] == got[1]["hash"] and len(got[0]["hash"]) == 64
    classes = spark.createDataFrame([("cat",), ("eel",)], "class string")
    assert {x["class"]: x.n for x in files.class_counts(found, classes).collect()} == {"cat": 1, "eel": 0}


def test_stream_dedup(spark, tmp_path):
    for i, rows in enumerate([[(1, "a"), (2, "a")], [(3, "a"), (4, "b")]]):
        spark.createDataFrame(rows, "i int, k string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = batches.stream(spark, f"file://{tmp_path}/in", "i int, k string")
    batches.dedup_batches(stream, "k", "i", f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    assert sorted(x.k for x in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "b"]


def test_stream_aggregate_in_files(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(9 - k, "a"), (k, f"b{k}")], "i int, k string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    rows = batches.stream(spark, f"file://{tmp_path}/in", "i int, k string").groupBy("k").agg(F.min("i").alias("i"), F.count("i").alias("n"))
    got = batches.run_to_files(rows, ["k"], "test")
    assert got.columns == ["k", "i", "n"]
    assert {(r.k, r.i, r.n) for r in got.collect()} == {("a", 7, 3), ("b0", 0, 1), ("b1", 1, 1), ("b2", 2, 1)}


def test_stream_dedup_first_is_read_from_files(spark):
    from marisma import registry

    assert registry.queries()["stream_dedup_first"](spark, "/root/testdata/sf0.001").inputFiles()


def test_atom_and_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>One</title><link>http://a/1</link><content:encoded xmlns:content='c'>&lt;b&gt;Body&lt;/b&gt; text</content:encoded><pubDate> </pubDate><dc:date xmlns:dc='d'>2026-01-02</dc:date></item><item><title>None</title></item></channel></rss>")
    (tmp_path / "b.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Two</title><link href='http://b/2'/><summary>Short</summary><updated>2026-01-03</updated><author><name>N</name></author></entry></feed>")
    from marisma.sources.feeds import feed_items

    got = {r.link: (r.title, r.text, r.published) for r in feed_items(spark, f"file://{tmp_path}").collect()}
    assert got == {"http://a/1": ("One", "Body text", "2026-01-02"), "http://b/2": ("Two", "Short", "2026-01-03")}


def test_landed_json_recent_first(spark, tmp_path):
    from marisma.sources.feeds import landed_json

    for name, rows in (("recent", '[{"url": "u1", "title": "new"}, {"url": "", "title": "none"}]'), ("past", '[{"url": "u1", "title": "old"}, {"url": "u2", "title": "two"}]')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.json").write_text(f'{{"articles": {rows}}}')
    assert {(r.url, r.title) for r in landed_json(spark, f"file://{tmp_path}/recent", f"file://{tmp_path}/past").collect()} == {("u1", "new"), ("u2", "two")}


def test_image_hashes(spark):
    import numpy as np

    from marisma.sources import files

    rows = [(bytes(range(64)),), (bytes([7] * 64),), (b"abc" * 200,), (None,), (b"",)]
    got = spark.createDataFrame(rows, "x binary").select("x", files.image_hash(F.col("x")).alias("h"), files.grey_hash(F.col("x")).alias("g")).collect()
    for r in got:
        raw = bytes(r.x) if r.x is not None else None
        assert r.h == files.byte_hash(raw)
        want = None
        if raw and len(raw) == 64:
            p = np.frombuffer(raw, np.uint8)
            want = np.packbits(p > p.mean()).tobytes().hex()
        assert r.g == want


def test_literal_terms(spark):
    from marisma.functions import text

    rows = spark.createDataFrame([("axb (b a.b", 0), ("A.B", 1), ("bird flu", 2), ("birds flu", 3), (None, 4)], "x string, i int")
    assert [r.y for r in rows.orderBy("i").select(text.has_word(F.col("x"), "a.b").alias("y")).collect()] == [True, True, False, False, None]
    assert [r.y for r in rows.orderBy("i").select(text.has_word(F.col("x"), "(b").alias("y")).collect()] == [True, False, False, False, None]
    lexicon = [("flu", "d", 1), ("bird flu", "d", 2), ("bird", "a", 1), ("a.b", "p", 1)]
    from marisma.operators.lexicon import hits

    got = [[h.term for h in r.h] if r.h is not None else None for r in rows.orderBy("i").select(hits(F.col("x"), lexicon).alias("h")).collect()]
    assert got == [["a.b"], ["a.b"], ["flu", "bird flu", "bird"], ["flu"], None]


def test_first_and_insert_on_ties(spark):
    from marisma.operators import dedup
    from marisma.sinks import tables

    new = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (None, "c", 1), (None, "d", 1), (2, "e", 1)], "k int, v string, o int")
    old = spark.createDataFrame([(2, "old", 9)], "k int, v string, o int")
    assert sorted((r.k or 0, r.v) for r in tables.insert_ignore(old, new, ["k"], "o").collect()) == [(0, "c"), (0, "d"), (1, "a"), (2, "old")]
    assert sorted((r.k or 0, r.v) for r in dedup.first_seen(new, "k", "o").collect()) == [(0, "c"), (0, "d"), (1, "a"), (2, "e")]


def test_long_cascade(spark, monkeypatch):
    """Each row shares a key with the one before it and one with the next."""
    from marisma.operators import dedup

    rows = spark.createDataFrame([(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(3000)], "o int, x string, y string")
    assert sorted(r.o for r in dedup.cascade(rows, ["x", "y"], "o").collect()) == list(range(0, 3000, 2))
    # components that are too large for one task shrink first
    monkeypatch.setattr(dedup, "COMPONENT", 20)
    monkeypatch.setattr(dedup, "SLOT", 5)
    some = rows.where("o < 60").withColumn("y", F.when(F.col("o") % 25 != 7, F.col("y")))
    want, taken = [], set()
    for r in sorted(some.collect()):
        if not {("x", r.x), ("y", r.y)} & taken:
            want.append(r.o)
            taken |= {("x", r.x)} | ({("y", r.y)} if r.y is not None else set())
    assert sorted(r.o for r in dedup.cascade(some, ["x", "y"], "o").collect()) == want


def test_failure_stream(spark, tmp_path):
    from marisma.streaming import batches

    at = f"file://{tmp_path}/runs"
    rows = [(1, 1, False), (1, 2, True), (1, 3, False), (1, 4, False), (2, 1, False), (2, 2, False)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "source int, at int, ok boolean").coalesce(1).write.mode("append").parquet(at)
    stream = batches.stream(spark, at, "source int, at int, ok boolean")
    out = batches.run_to_files(batches.failure_counts(stream, "source", "at", "ok"), ["source"], "failures")
    assert {(r.source, r.runs, r.failures) for r in out.collect()} == {(1, 4, 2), (2, 2, 2)}


def test_origin_names():
    from marisma.operators import filters

    assert [filters.origin_id(x) for x in ("Redes", "red", "prensa", "radio", None, " ")] == ["social", "social", "prensa", None, None, None]


def test_cosine_tiles(spark):
    """Ties and several tiles of rows and queries; no product is larger than a tile, however many queries there are."""
    import numpy as np

    from marisma.operators import relations

    r = np.random.default_rng(2)
    vectors = [[1.0, 0.0, 0.0]] * 300 + [[0.0, 0.0, 0.0]] * 2 + r.integers(-3, 4, (5000, 3)).astype(float).tolist()
    ids = list(range(len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "i long, v array<double>").repartition(2).cache()
    asked = df.where("i < 1300")
    x = np.array(vectors)
    with np.errstate(invalid="ignore"):
        c = np.round(x[:1300] @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x[:1300], axis=1)[:, None], 9)
    np.fill_diagonal(c, np.nan)
    got = {}
    for row in relations.cosine_pairs(asked, df, "i", "v", most=4).collect():
        got.setdefault(row.query, {})[row.turn] = (row.match, round(row.cosine, 6))
    for q in range(0, 1300, 13):
        want = [(int(m), round(float(c[q, m]), 6)) for m in np.lexsort((x[:, 0] * 0 + ids, -np.nan_to_num(c[q], nan=-3)))[:4] if not np.isnan(c[q, m])]
        assert [got.get(q, {})[t] for t in sorted(got.get(q, {}))] == want
    near = relations.cosine_pairs(asked, df, "i", "v", least=0.99)
    assert near.count() == int((np.nan_to_num(c, nan=-3) >= 0.99).sum())
    assert relations.TILE[0] * relations.TILE[1] <= 1 << 20


def test_similar_meets_few_rows(spark):
    """As scores of all pairs; a query meets a few rows of each kind, however many sources share its tags."""
    import random

    from marisma.operators import stories

    r = random.Random(6)
    rows = [(i, r.sample(["a", "b", "c"], r.randint(0, 3)), r.choice(["h1", "h2", "h3", None]), r.choice([None, *(f"s{k}" for k in range(120))])) for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, tags array<string>, h string, s string")
    top = stories.similar(df.where("i % 20 = 0"), df, "i", "tags", "h", "s", 3)
    want = set()
    for q, x, qh, qs in rows[::20]:
        scored = [(-(4 * len(set(x) & set(y)) + 8 * (qh is not None and qh == h) + (qs is not None and qs == s)), m) for m, y, h, s in rows if m != q]
        want |= {(q, m, -n) for n, m in sorted(x for x in scored if x[0] < 0)[:3]}
    assert {tuple(x) for x in top.collect()} == want
    plan = top._jdf.queryExecution().executedPlan()
    counts, todo = [], [plan.executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            counts.append(node.metrics().apply("numOutputRows").value())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    assert counts and sum(counts) < 75 * 200


def test_claims_read_sentences_once(spark):
    """Rows without a claim get their first characters, those that repeat a key too; the texts are split once."""
    from marisma.operators import reviews

    bare = "nothing of the kind here"
    claim = "Se confirma un brote en la granja grande."
    rows = [(1, f"{claim} {bare}. {claim}"), (2, bare), (2, bare), (3, " "), (4, None), (5, claim + " Hay cuarentena en todo el estado."), (6, "brote")]
    df = spark.createDataFrame(rows, "i int, t string")
    out = reviews.claims(df, "i", F.col("t"), F.array().cast("array<string>"), {}, {}, {})
    assert sorted((r.i, r.turn, r.kind) for r in out.collect()) == [(1, 1, "brote"), (2, 1, ""), (2, 1, ""), (5, 1, "brote"), (5, 2, "medida_oficial"), (6, 1, "")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_severity_of_all_claims(spark):
    """Conspiracies are the last kind: the gravest claim is found behind any number of others if claims are not cut."""
    from marisma.operators import assessment, reviews

    many = " ".join(f"Se confirma un brote en la granja {i}." for i in range(12)) + " Todo fue una creada artificial según dicen."
    df = spark.createDataFrame([(1, many), (2, "nothing of the kind here")], "i int, t string")
    found = {most: reviews.claims(df, "i", F.col("t"), F.array().cast("array<string>"), {}, {}, {}, most=most) for most in (8, None)}
    grave = {m: dict(map(tuple, assessment.severity(c, "i", "kind", "predicate", "verifiable").collect())) for m, c in found.items()}
    assert grave == {8: {1: 45, 2: 35}, None: {1: 80, 2: 35}}
    assert sorted((r.i, r.turn) for r in found[None].collect()) == [(1, n) for n in range(1, 14)] + [(2, 1)]


def test_contrast_makes_each_pair_once(spark):
    from marisma.operators import reviews

    claims = spark.createDataFrame([(1, "Gripe aviar en aves de Texas"), (2, "Nada"), (3, None)], "id int, claim string")
    said = "SENASICA confirma la gripe aviar en aves de corral de Texas este lunes. La plaza abrió con pocos cambios en la semana."
    evidence = spark.createDataFrame([(1, said, "a", 1), (1, "corto", "b", 2), (2, said, "c", 1), (3, None, "d", 1)], "id int, snippet string, title string, n int")
    peers = spark.createDataFrame([(2, "x", 9)], "id int, title string, peer int")
    out = reviews.contrast(claims, evidence, peers, "id")
    assert {r["id"]: (r["status"], r["title"], r["snippet"], r["peers"]) for r in out.collect()} == {1: ("hit", "a", said.split(" La plaza")[0] + " La plaza abrió con pocos cambios en la semana.", 0), 2: ("peer", None, None, 1), 3: ("none", None, None, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3
    assert len(plan) < 200_000


def test_few_needles_like_many(spark):
    from marisma.functions import facts

    texts = ["gripe aviar", "la gripes, aviares", "hog cholera", "xhog cholerax", "nws.", "ánws nws", "h5n1-h5n2", "usa u.s. ee.uu", "méxico new mexico nuevo méxico", "", None, "swine\nhpai", "_hpai hpaiá"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for named in (facts.DISEASES, facts.PLACES):
        assert sum(map(len, named.values())) <= facts.FEW
        got = rows.select(facts.canonical(F.col("t"), named).alias("few"), facts._all_at_once(F.col("t"), named).alias("many")).collect()
        assert all(r["few"] == r["many"] for r in got)


def test_signs_of_claims(spark):
    from marisma.functions import facts

    low = ["casos confirmados", "un foco", "sacrificio  sanitario", "30 por ciento", "7%", "la frontera", "vacunación", "arma   biológica", "creada artificialmente", "ocultan", "sin nada"]
    rows = spark.createDataFrame([(t,) for t in low], "low string")
    kinds = [F.col("low").rlike(p) for p in facts.CLAIM_KINDS.values()]
    got = rows.select("low", facts.claimed(F.col("low")).alias("may"), F.greatest(*[k.cast("int") for k in kinds]).alias("is")).collect()
    assert all(r["may"] for r in got if r["is"])
    assert [r["low"] for r in got if not r["may"]] == ["sin nada"]


def test_severity_is_told_in_one_pass(spark):
    from marisma.plans import prose

    plan = prose.severity_told(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1


def test_charts_count_in_one_pass(spark):
    from marisma.plans import payloads

    plan = payloads.chart_payload(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 4  # counts, days, their ends, titles


def test_peers_read_texts_once(spark):
    from marisma.plans import articles

    plan = articles.peer_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 0 and "lower(" not in plan
