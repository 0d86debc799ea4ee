"""Operators of the llm subpackage against brute force, and on awkward tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marisma.llm import bytetext, decontam, exact_dedup, jaccard_join, language_id, line_dedup, lm_score, quality_cnn, url_filter
from marisma.session import ship

AZ = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, pos int, key string, n_dropped string, hash string"


def words(x):
    return [w for w in re.split("[\x20\x09-\x0d]+", (x or "").translate(AZ)) if w]


@pytest.fixture(scope="module")
def awkward(spark):
    long = "lorem ipsum dolor sit amet " * 12000
    texts = [None, "", " \t\n", "one", "Shared line that is long enough to count for it all\nown 1", *[f"x{i}\n shared LINE that is long enough to count for it all \n" for i in range(6)], long, long, "é ß 漢字 😀", "a\x0bb\x0cc\rd", "12 34 ..", "same words here now ok", "same words here now ok", "Same  words here\nnow ok"]
    rows = [(i if i != 5 else None, t, ["en", "fr", None][i % 3], None if i % 4 else "s", None, 0.5, 1, "k", "z", None) for i, t in enumerate(texts)]
    rows.append((3, "one", "en", "s", 3, 0.5, 1, "k", "z", None))
    return spark.createDataFrame(rows, SCHEMA)


def test_line_dedup(awkward):
    rows = awkward.collect()
    where = collections.defaultdict(set)
    keyed = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(AZ)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(keyed(line)) >= 40:
                where[keyed(line)].add(-1 if r.doc_id is None else r.doc_id)
    want = []
    for r in rows:
        lines, own = (r.text or "").split("\n"), -1 if r.doc_id is None else r.doc_id
        kept = [x for x in lines if not (len(where.get(keyed(x), ())) >= 5 and max(where[keyed(x)]) != own)]
        want.append((own, len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.dedup_lines(awkward)
    assert set(awkward.columns) | {"n_lines", "n_dropped"} == set(out.columns)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == sorted(want)
    assert line_dedup.dedup_lines(awkward.limit(0)).count() == 0


def test_exact_dedup(spark, awkward, tmp_path):
    at = f"file://{tmp_path}/docs"
    awkward.repartition(4).write.parquet(at)
    rows = awkward.collect()
    bare = lambda x: re.sub("[\x20\x09-\x0d]", "", x or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[bare(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    got = exact_dedup.dedup_stream(spark, at, max_batch_bytes=1).collect()
    assert len(got) == len(rows)
    want = collections.Counter((r.doc_id, min(groups[bare(r.text)])[2], len(groups[bare(r.text)]), hashlib.sha256(bare(r.text).encode()).hexdigest()) for r in rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    awkward.limit(0).write.parquet(f"{at}-none")
    assert exact_dedup.dedup_stream(spark, f"{at}-none").count() == 0


def test_exact_dedup_goes_on(spark, tmp_path):
    """A second run reads only new files and knows all texts before; a weak digest puts unlike texts under one key."""
    at, state = f"file://{tmp_path}/grown", f"file://{tmp_path}/state"
    r = np.random.default_rng(14)
    weak = lambda bare: F.unhex(F.substring(F.sha2(bare, 256), 1, 2))
    every = []
    for run in range(2):
        rows = [(100 * run + i, f"text {r.integers(40)}" + " " * int(r.integers(3))) for i in range(60)]
        every += rows
        spark.createDataFrame(rows, "doc_id bigint, text string").write.mode("append").parquet(at)
        groups = collections.defaultdict(list)
        for i, t in every:
            groups[t.replace(" ", "")].append((-len(t), i))
        want = sorted((i, min(groups[t.replace(" ", "")])[1], len(groups[t.replace(" ", "")])) for i, t in every)
        for digest, folder in ((exact_dedup.sha, state), (weak, f"{state}-weak")):
            got = exact_dedup.dedup_stream(spark, at, max_batch_bytes=1, state=folder, digest=digest).collect()
            assert sorted((x.doc_id, x.keep_id, x.group_size) for x in got) == want
            assert sum(x.kept for x in got) == len(groups)


def test_exact_dedup_large_group(spark, tmp_path):
    """Groups of more than 500 rows are compared with their locator in parts, also where one digest holds unlike texts."""
    at = f"file://{tmp_path}/large"
    rows = [(i, "same text" if i % 3 else "other text") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(at)
    one = lambda bare: F.unhex(F.substring(F.sha2(F.substring(bare, 100, 1), 256), 1, 2))
    got = exact_dedup.dedup_stream(spark, at, digest=one).collect()
    assert collections.Counter((x.keep_id, x.group_size) for x in got) == {(0, 500): 500, (1, 1000): 1000}


def links(texts, size, percent):
    sets = []
    for x in texts:
        w = words(x)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return sets, root


@pytest.mark.parametrize("size,percent,small", [(3, 90, False), (5, 80, True), (1, 50, False), (1, 50, True)])
def test_jaccard_components(spark, monkeypatch, size, percent, small):
    """With small limits also: signatures of many sets, several blocks of members, several parts of a pivot, several flushes of a task."""
    if small:
        for name, value in (("DIRECT", 2), ("FLUSH", 300), ("BLOCK_MEMBERS", 3), ("PART", 2), ("SLOT", 7), ("BUCKET_CHARS", 500), ("NEAREST", 2)):
            monkeypatch.setattr(jaccard_join, name, value)
    r = np.random.default_rng(size)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "one", "one", "two words"]
    for n in (6, 15, 40, 120):
        base = list(r.choice(vocabulary, n))
        for k in range(12):
            copy = list(base)
            for at in r.integers(0, n, k * n // 60):
                copy[at] = "x" + str(r.integers(99))
            texts.append(" ".join(copy).upper() if k % 2 else "\n".join(copy))
    sets, root = links(texts, size, percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(df, size, percent).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(texts))}


def test_jaccard_links(spark):
    """All links inside a component, between different texts and copies."""
    r = np.random.default_rng(13)
    texts = [None, "", "one", "one"]
    for n in (15, 60):
        base = [f"b{n}x{i}" for i in range(n)]
        for k in range(10):
            copy = list(base)
            for at in r.integers(0, n, k % 5):
                copy[at] = "x" + str(r.integers(99))
            texts += [" ".join(copy)] * (1 + k % 3)
    sets, _ = links(texts, 1, 80)
    similar = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pairs, counts = jaccard_join.jaccard_links(df, 1, 80)
    counts = counts.collect()
    assert {x.doc_id: (x.n_shingles, x.n_links) for x in counts} == {i: (len(a), sum(bool(similar(a, b)) for j, b in enumerate(sets) if j != i)) for i, a in enumerate(sets)}
    name = {bytes(x.id): frozenset(sets[x.doc_id]) for x in counts}
    distinct = set(name.values())
    assert sorted(sorted(map(sorted, (name[bytes(x.a)], name[bytes(x.b)]))) for x in pairs.collect()) == sorted(sorted(map(sorted, (a, b))) for a in distinct for b in distinct if sorted(a) < sorted(b) and similar(a, b))


def test_jaccard_awkward(awkward):
    got = jaccard_join.jaccard_components(awkward, 5, 80).collect()
    assert len(got) == awkward.count()
    by = collections.defaultdict(set)
    for x in got:
        by[x.doc_id].add(x.component_id)
    assert by[12] == {11} and by[18] == {16} and by[0] == {0}
    assert jaccard_join.jaccard_components(awkward.limit(0)).count() == 0


def test_signatures_lose_no_pair():
    """Sets that are just similar enough share a signature, at many sizes."""
    r = np.random.default_rng(2)
    for percent in (80, 90):
        scheme = jaccard_join.Scheme(percent)
        for n in [*range(1, 40), 75, 160, 333, 1000]:
            for _ in range(6):
                a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
                change = 0
                while True:
                    keep = len(a) - (change + 1)
                    if keep < 1 or 100 * keep < percent * (len(a) + change + 1):
                        break
                    change += 1
                b = np.unique(np.concatenate([r.permutation(a)[: len(a) - change], r.integers(0, 2**63, change, dtype=np.uint64) * np.uint64(2)]))
                shared = len(np.intersect1d(a, b))
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    sign, who = scheme.signatures([a, b])
                    assert len(np.intersect1d(sign[who == 0], sign[who == 1]))


def test_pair_gradient_against_all_sequences():
    """Expected pairs of labels, the place before the first word among them, are those of all sequences together."""
    import itertools

    r = np.random.default_rng(8)
    k, size = 3, (6, 4)
    e, t = r.normal(size=(sum(size), k)).astype(np.float32), r.normal(size=(k, k)).astype(np.float32)
    want, first = np.zeros((k, k)), np.array([0, *np.cumsum(size)])
    for a, b in zip(first[:-1], first[1:]):
        sums, total = np.zeros((k, k)), 0.0
        for y in itertools.product(range(k), repeat=b - a + 1):
            v = np.exp(sum(e[a + i, y[i + 1]] for i in range(b - a)) + sum(t[y[i], y[i + 1]] for i in range(b - a)))
            total += v
            for i in range(b - a):
                sums[y[i], y[i + 1]] += v
        want += sums / total
    got = np.zeros((k, k))
    language_id.marginals(e, first, t, got)
    assert got == pytest.approx(want, rel=1e-4)


def test_marginals_against_all_sequences(monkeypatch):
    import itertools

    monkeypatch.setattr(language_id, "SEGMENT", 3)
    r = np.random.default_rng(1)
    e, t = r.normal(size=(7, 3)).astype(np.float32), r.normal(size=(3, 3)).astype(np.float32)
    total = np.zeros((7, 3))
    for y in itertools.product(range(3), repeat=7):
        v = np.exp(sum(e[i, y[i]] for i in range(7)) + sum(t[y[i - 1], y[i]] for i in range(1, 7))) * np.exp(t)[:, y[0]].sum()
        for i in range(7):
            total[i, y[i]] += v
    assert np.allclose(language_id.marginals(e, np.array([0, 7]), t), total / total.sum(1, keepdims=True), atol=1e-5)


def test_languages(spark, awkward):
    r = np.random.default_rng(3)
    own = {"en": ["the", "and", "thing", "shion"], "fr": ["les", "des", "eaux", "ment"], "de": ["der", "und", "heit", "schei"]}
    rows = []
    for i in range(240):
        lang = list(own)[i % 3]
        rows.append((i, " ".join("".join(r.choice(own[lang], r.integers(1, 3))) for _ in range(30)), lang, "s"))
    docs = spark.createDataFrame([*rows, (500, None, None, "s"), (501, "12 ! 3", "fr", "s"), (502, "the and les des thing the", None, None)], "doc_id bigint, text string, lang string, source string")
    got = {x.doc_id: x for x in language_id.predict_languages(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in held]) > 0.95
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[500].lang_score == 0
    assert all(0 <= x.lang_score <= 1 for x in got.values())
    assert language_id.predict_languages(awkward).count() == awkward.count()
    assert language_id.predict_languages(awkward.limit(0)).count() == 0


def test_python_holds_few_texts_at_once(spark):
    ship(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    docs = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    got = docs.mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(x.n for x in got) == 9000 and max(x.size for x in got) < 5_000_000


def test_powers_are_no_longer_than_needed(monkeypatch):
    monkeypatch.setattr(bytetext, "_POWERS", {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)})
    for n in (2, 70_001, 262_142):
        data = np.frombuffer(b"ab " * n, np.uint8)[:n]
        assert len(np.unique(bytetext.words(data, np.array([0, n])).hash)) == 1
        assert n < len(bytetext._POWERS["up"]) == len(bytetext._POWERS["down"]) <= max(2 * n, 1 << 16)


def test_quality(spark, awkward):
    r = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(300):
        clean = " ".join(r.choice(["the", "river", "runs", "down", "hill"], 60))
        rows.append((i, clean if i % 2 else clean.replace(" ", "%%% ").upper()))
        labels.append((i, i % 2, 0))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {x.doc_id: x for x in quality_cnn.score_quality(docs, marks).collect()}
    assert np.mean([got[i].predicted == i % 2 for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.95
    assert all(0 <= x.score <= 1 for x in got.values()) and len(got) == 302
    assert {x.score for x in quality_cnn.score_quality(awkward, marks.limit(0)).collect()} == {0.5}
    assert quality_cnn.score_quality(docs.limit(0), marks).count() == 0


def test_lm_scores(spark, awkward):
    r = np.random.default_rng(6)
    rows = [(i, " ".join(r.choice(["Alpha", "beta", "gamma", "delta", f"rare{i}"], 40))) for i in range(200)]
    df = spark.createDataFrame([*rows, (300, None)], "doc_id bigint, text string")
    got = {x.doc_id: x for x in lm_score.score_documents(df).collect()}
    learn = [(i, t) for i, t in [*rows, (300, "")] if zlib.crc32(str(i).encode()) % 10]
    counts = collections.Counter(w for _, t in learn for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in [*rows[:40], (300, "")]:
        own = [*words(t), None]
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(own), sum(w in counts for w in own), n)
        assert x.base_score == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert x.score < 0
    assert lm_score.score_documents(awkward).count() == awkward.count()
    assert lm_score.score_documents(awkward.limit(0)).count() == 0


def test_lm_gradient_and_sum():
    r = np.random.default_rng(0)
    m = lm_score.Model(r.zipf(1.5, 3000).astype(float))
    w = r.integers(0, lm_score.KNOWN + 1, (4, lm_score.WINDOW + 1))
    w[0, -5:] = -1

    def loss():
        c, t = m._context(np.maximum(w[:, :-1], 0)), w[:, -lm_score.NEW :]
        return -m.log_probability(c["x2"][t >= 0], t[t >= 0]).mean()

    g = m._gradient(w)
    for name in ("q", "k", "v", "out", "w1", "w2", "class_w", "place", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        for e in (1e-2,):
            m.p[name][at] += e
            up = loss()
            m.p[name][at] -= 2 * e
            down = loss()
            m.p[name][at] += e
        assert (up - down) / (2 * e) == pytest.approx(g[name][at], rel=0.1, abs=2e-4), name
    x = r.normal(size=(1, lm_score.DIM)).astype(np.float32)
    known = np.exp(m.log_probability(np.repeat(x, lm_score.KNOWN + 1, 0), np.arange(lm_score.KNOWN + 1))).sum()
    assert known == pytest.approx(1, abs=1e-3)
    assert np.exp(m.rare_log[m.number == lm_score.RARE]).sum() == pytest.approx(1)


def test_each_id_is_scored_once(monkeypatch):
    m = lm_score.Model(np.arange(3000, 0, -1).astype(float))
    seen = np.zeros(500)
    monkeypatch.setattr(m, "log_probability", lambda x, t: (np.add.at(seen, t, 1), np.zeros(len(t)))[1])
    m.number = np.arange(3000)
    m.scores(np.arange(500), np.array([0, 1, 24, 25, 80, 500]))
    assert (seen == 1).all()


def test_each_id_is_learned_once(spark):
    """Windows hold every id of every text as one target, and each gathered text is in one round."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    r = np.random.default_rng(12)
    docs = spark.createDataFrame([(" ".join(r.choice(["alpha", "beta", "gamma"], n)), i) for i, n in enumerate((0, 1, 22, 23, 24, 700, 5000))], "text string, mark bigint")
    rows = docs.mapInArrow(lm_score._gather(path), "kind int, key bigint, n bigint, payload binary").collect()
    counts = collections.Counter()
    for x in rows:
        if x.kind == lm_score._PIECES:
            counts[x.key] += x.n
    model = lm_score.Model(np.arange(lm_score.pieces(path).size, 0, -1.0))
    model.number = np.arange(len(model.number))
    got = collections.Counter()
    for x in rows:
        if x.kind == lm_score._WINDOWS:
            target = lm_score._numbered(model, [bytes(x.payload)])[:, -lm_score.NEW :]
            got.update(target[target >= 0].tolist())
    assert got == counts


def test_a_group_is_learned_in_one_pass(monkeypatch):
    """A group held in pieces is passed over once; what is left for the last piece is not gone over again and again."""
    monkeypatch.setattr(lm_score, "AT_ONCE", 256)
    monkeypatch.setattr(lm_score, "LEAST", 3)
    m = lm_score.Model(np.arange(3000, 0, -1).astype(float))
    seen, gradient = [], m._gradient
    monkeypatch.setattr(m, "_gradient", lambda w: (seen.append(len(w)), gradient(w))[1])
    payloads = [(np.arange(n) % 3000).astype("<u2").tobytes() for n in (24 * 200, 24 * 57, 30)]
    assert lm_score._learn(m, payloads, 0.01, 0) == 259
    assert sum(seen) == 259
    seen.clear()
    assert lm_score._learn(m, payloads[2:], 0.01, 0) == 2
    assert seen == [2] * 3


def test_far_logits():
    """Logits beyond what exponentials hold give the same shares as in double precision, alone and beside others."""
    r = np.random.default_rng(31)
    for logits in (r.normal(size=(7, 5)) * 3, r.normal(size=(7, 5)) * 200, np.vstack([r.normal(size=(3, 5)) + 300, r.normal(size=(3, 5)) - 300, [[0, -110, -120, -1, -2]] * 4])):
        which = r.integers(0, 5, len(logits))
        log = logits - logits.max(1, keepdims=True)
        log -= np.log(np.exp(log).sum(1, keepdims=True))
        make = lambda: logits.astype(np.float32)  # noqa: B023, E731
        assert lm_score._log_share(make, which) == pytest.approx(log[np.arange(len(log)), which], rel=1e-4, abs=1e-4)
        want = (np.exp(log) - np.eye(5)[which]) * 0.5
        assert lm_score._wrong(make, which, np.full(len(log), 0.5, np.float32)) == pytest.approx(want, abs=1e-4)
    m = lm_score.Model(r.zipf(1.5, 3000).astype(float))
    w = r.integers(0, lm_score.KNOWN + 1, (4, lm_score.WINDOW))
    near = m._context(w)["x2"]
    m.p["q"] = m.p["q"] * np.float32(1e4)
    assert np.isfinite(near).all() and np.isfinite(m._context(w)["x2"]).all()


def test_scores_against_plain_attention():
    """Each id's probability from its window alone, one place at a time, with the whole softmax."""
    r = np.random.default_rng(21)
    m = lm_score.Model(r.zipf(1.4, 4000).astype(float))
    for name in m.p:
        m.p[name] = m.p[name] + r.normal(size=m.p[name].shape).astype(np.float32) * np.float32(0.1)
    p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids = r.integers(0, 4000, 131)
    first = np.array([0, 1, 30, 131])
    want = []
    for a, b in zip(first[:-1], first[1:]):
        total = 0.0
        numbers = m.number[ids[a:b]]
        for i in range(b - a):
            start = i // lm_score.NEW * lm_score.NEW + lm_score.NEW - lm_score.WINDOW
            seen = [lm_score.BEGIN if j < 1 else numbers[j - 1] for j in range(start, i + 1)]
            x0 = p["embed"][seen] + p["place"][: len(seen)]
            q = x0[-1] @ p["q"] / np.sqrt(lm_score.DIM)
            e = np.exp((x0 @ p["k"]) @ q)
            x1 = x0[-1] + (e / e.sum()) @ (x0 @ p["v"]) @ p["out"]
            x2 = x1 + np.maximum(x1 @ p["w1"] + p["b1"], 0) @ p["w2"]
            log_softmax = lambda z: z - np.log(np.exp(z).sum())
            n = numbers[i]
            kind = n // lm_score.MEMBERS
            total += log_softmax(x2 @ p["class_w"] + p["class_b"])[kind]
            total += m.rare_log[ids[a + i]] if n == lm_score.RARE else log_softmax(x2 @ p["member_w"][kind] + p["member_b"][kind])[n % lm_score.MEMBERS]
        want.append(total / np.log(10))
    assert m.scores(ids, first) == pytest.approx(want, rel=1e-4)


def test_lm_tail(spark, monkeypatch):
    """Words outside the table that is sent to all tasks count the same; partitions make no difference."""
    r = np.random.default_rng(16)
    rows = [(i, " ".join(r.choice([f"w{k}" for k in range(60)], 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = {x.doc_id: x for x in lm_score.score_documents(df).collect()}
    monkeypatch.setattr(lm_score, "HEAD", 7)
    for x in lm_score.score_documents(df.repartition(3, "text")).collect():
        own = whole[x.doc_id]
        assert (x.n_known, x.n_tokens, x.train_tokens) == (own.n_known, own.n_tokens, own.train_tokens)
        assert x.base_score == pytest.approx(own.base_score) and x.score == pytest.approx(own.score, rel=1e-4)


def test_word_tables():
    r = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in r.zipf(1.2, 400) % 5000) for _ in range(30)]
    memory, counts, got = bytetext.WordMemory(np.uint32, bits=6, most=500), bytetext.WordCounts(bits=5), collections.Counter()
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        w = bytetext.words(raw, np.array([0, len(raw)]))
        flat, size = memory.ids(w, lambda ws: [[len(x), int(x[1:])] for x in ws])
        assert flat.tolist() == [v for x in t.split() for v in (len(x), int(x[1:]))] and set(size) == {2}
        for h, n in zip(*counts.add(w.hash), strict=True):
            got[h] += n
    for h, n in zip(*counts.rest(), strict=True):
        got[h] += n
    assert sorted(got.values()) == sorted(collections.Counter(x for t in texts for x in t.split()).values())
    keys = np.array(list(got), np.uint64)
    index = bytetext.HashIndex(keys)
    assert np.array_equal(index.find(keys), np.arange(len(keys))) and index.find(np.array([1], np.uint64))[0] == len(keys)


def test_lcs():
    r = np.random.default_rng(4)
    for _ in range(50):
        a, b = r.integers(1, 6, r.integers(0, 30)), r.integers(0, 6, r.integers(0, 30))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.lcs(a, b) == table[-1, -1]


def test_lcs_bounds():
    r = np.random.default_rng(11)
    codes, row = r.integers(0, 9, 400), np.zeros(9, np.uint64)
    left = r.integers(0, 380, 60)
    right = np.minimum(left + r.integers(0, 150, 60), 400)
    for n in (1, 3, 40, 64, 65, 150):
        item = r.integers(1, 9, n)
        want = np.array([decontam.lcs(item, codes[a:b]) for a, b in zip(left, right)])
        got = decontam.lcs_bounds(item, codes, left, right, row)
        assert (got >= want).all() and (n > 64 or (got == want).all()) and not row.any()


def test_bounds_of_items_side_by_side(monkeypatch):
    """Ranges of short and long items, in small pieces and together, have the bounds they have alone."""
    r = np.random.default_rng(41)
    codes = r.integers(0, 60, 3000)
    items = [r.integers(1, 60, n) for n in (3, 12, 63, 64, 65, 200)]
    which = r.integers(0, len(items), 300)
    left = r.integers(0, 2900, 300)
    right = np.minimum(left + r.integers(0, 300, 300), 3000)
    want = np.zeros(300, np.int64)
    for c in range(300):
        item = items[which[c]]
        want[c] = sum(decontam.lcs(item[i : i + 64], codes[left[c] : right[c]]) for i in range(0, len(item), 64))
    for lanes, cells in ((4096, 1 << 20), (7, 1 << 20), (4096, 1000), (1, 1)):
        monkeypatch.setattr(decontam, "LANES", lanes)
        monkeypatch.setattr(decontam, "CELLS", cells)
        row = np.zeros(61, np.uint64)
        assert (decontam.bounds_of(items, which, codes, left, right, row) == want).all() and not row.any()
    assert len(decontam.bounds_of(items, which[:0], codes, left[:0], right[:0], row)) == 0


def test_ranges_are_taken_together(monkeypatch):
    """Near ranges of an item are looked at as one first; what is found is what each range alone holds."""
    r = np.random.default_rng(43)
    codes = r.integers(0, 400, 4000)
    items = [r.integers(1, 400, n) for n in (12, 30, 90)]
    for i, at in enumerate((500, 1500, 2500)):
        codes[at : at + len(items[i])] = np.where(r.random(len(items[i])) < 0.7, items[i], 0)
    left = np.tile(np.arange(0, 3800, 8), 3)
    which = np.repeat(np.arange(3), len(left) // 3)
    right = np.minimum(left + np.array([60, 80, 140])[which], 4000)
    least = np.array([6, 15, 45])[which]
    row, lanes, bounds = np.zeros(401, np.uint64), [], decontam.bounds_of
    want = np.flatnonzero(bounds(items, which, codes, left, right, row) >= least)
    assert {0, 1, 2} == set(which[want])
    monkeypatch.setattr(decontam, "bounds_of", lambda *x: (lanes.append(len(x[1])), bounds(*x))[1])
    mixed = r.permutation(len(left))
    got = decontam.may_hold(items, which[mixed], least[mixed], codes, left[mixed], right[mixed], row)
    assert np.sort(mixed[got]).tolist() == want.tolist() and sum(lanes) < len(left) / 3
    assert not len(decontam.may_hold(items, which[:0], least[:0], codes, left[:0], right[:0], row))


def test_sums_over_windows():
    """Sums over windows of words that items have or not, also of none and of a whole stretch."""
    r = np.random.default_rng(42)
    table = r.normal(size=(50, 9)).astype(np.float32)
    table[0] = 0
    for share in (0, 0.4, 1):
        for n in (1, 15, 16, 17, 900):
            codes = np.where(r.random(n) < share, r.integers(1, 50, n), 0)
            _, begin, end = decontam.windows(np.array([0, n // 3, n // 3, n]), 24, 8)
            want = [table[codes[a:b]].sum(0) for a, b in zip(begin, end)]
            assert decontam._project(table, codes, begin, end) == pytest.approx(np.array(want), abs=1e-3)
    assert decontam._project(table, codes, begin[:0], end[:0]).shape == (0, 9)


def test_decontamination(spark, awkward):
    r = np.random.default_rng(9)
    word = lambda: "".join(r.choice(["ba", "ko", "ti", "ru", "se"], r.integers(1, 5)))
    prose = lambda n: [str(r.choice(["the", "of", "and"])) if r.random() < 0.4 else word() for _ in range(n)]
    items = [prose(n) for n in (18, 30, 55, 7, 40)]
    docs = [" ".join(prose(200)) for _ in range(60)]
    planted = {}
    for k, item in enumerate(items):
        host = prose(150)
        docs.append(" ".join(host[:70] + item + host[70:]))
        planted[len(docs) - 1] = k
        changed = [word() + "x" if i % 6 == 5 and i < len(item) - 8 else w for i, w in enumerate(item)]
        docs.append(" ".join(host[:20] + changed + host[20:]).upper())
        planted[len(docs) - 1] = k
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    bench = spark.createDataFrame([*[(k, " ".join(x)) for k, x in enumerate(items)], (8, None), (9, " ")], "item_id bigint, text string")
    assert {x.doc_id: x.item_id for x in decontam.find_leaks(df, bench).collect()} == planted
    assert decontam.drop_leaks(awkward, bench).columns == awkward.columns
    assert decontam.find_leaks(awkward, bench).count() == 0
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0
    assert decontam.find_leaks(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("n_docs", [60, 600, 2400])
def test_paraphrases_are_found_at_any_corpus_size(spark, n_docs):
    """Words that no item has get rarer as the corpus grows; items in which they replace a quarter of the words are still found."""
    r = np.random.default_rng(n_docs)
    vocabulary = [f"w{i}" for i in range(100)]
    items = [list(r.choice(vocabulary, 40)) for _ in range(10)]
    mixed = lambda n: [str(r.choice(vocabulary)) if r.random() < 0.4 else f"x{r.integers(1 << 40)}" for _ in range(n)]
    docs = [mixed(48) for _ in range(n_docs)]
    for item in items:
        changed = [f"y{r.integers(1 << 40)}" if i % 18 in (1, 5, 8, 12, 16) else w for i, w in enumerate(item)]
        docs.append(mixed(30) + changed + mixed(30))
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    coded = lambda ws: np.array([number.get(w, 0) for w in ws])
    want = {(i, k) for i, d in enumerate(docs) for k, item in enumerate(items) if decontam.lcs(coded(item), coded(d)) >= 0.7 * len(item)}
    assert len(want) >= len(items)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.find_leaks(df, bench).collect()} >= want


def test_urls(spark):
    rows = [(1, "https://A.Example.ORG/es/1"), (2, "http://example.org/en/17?x"), (3, "http://b.org/q"), (4, "https://x.com/fr/1#a"), (5, "https://x.com/de/"), (6, "https://com/fr/"), (7, None), (8, "nonsense"), (9, "http://notexample.org/es/1"), (10, "https://x.net/de/1?a=1&b=2"), (10, "https://x.net/de/1?a=1&b=2"), (11, "http://host"), (12, "http://h.org" + "/a" * 20000)]
    got = url_filter.judge_urls(spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, label string")).collect()
    assert len(got) == len(rows)
    by = {x.page_id: (x.host, x.rule, x.verdict) for x in got}
    assert by[1] == ("a.example.org", "example.org/es/", "block") and by[2] == ("example.org", "example.org/en/1", "block") and by[3] == ("b.org", "org/", "allow")
    assert by[4][1:] == ("com/fr/", "allow") and by[5][1:] == ("com/de/", "block") and by[6][1:] == ("com/fr/", "allow")
    assert by[7][:2] == ("", None) and by[8][:2] == ("", None) and by[9][1:] == ("org/", "allow") and by[10][1] is None
    assert all(x.verdict in ("allow", "block") for x in got)
    none = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert [x.verdict for x in url_filter.judge_urls(none).collect()] == ["allow"]
    assert url_filter.judge_urls(none.limit(0)).count() == 0


def test_pipeline(spark, tmp_path, awkward):
    import corpus_pipeline

    text = "The committee of the town met and spoke of the new bridge over the river and of its cost to all who live there"
    rows = [(i, f"{text} {i} " + " ".join(f"term{i}x{k}" for k in range(40)), "en", "s", 1) for i in range(12)]
    rows += [(20, rows[3][1] + " end", "en", "s", 1), (21, "12 34", "en", "s", 1), (22, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    leak = " ".join(rows[5][1].split()[24:60])
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {x.doc_id for x in got} == {*range(12)} - {5}
    assert {x.doc_id: x.decoded_sha256 for x in got}[4] == hashlib.sha256(rows[4][1].encode()).hexdigest()
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, awkward, f"file://{tmp_path}")
        assert out.columns == awkward.columns
        assert stage(spark, awkward.limit(0), f"file://{tmp_path}").count() == 0
        out.count()


def test_near_stage_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"t{k}x{i}" for i in range(40))
    rows = [
        (1, text(1)), (None, text(1) + " end"),  # a null id linked to an id
        (None, text(2)), (None, text(3)), (None, None), (None, ""),  # null ids linked to nothing
        (None, text(4)), (None, text(4) + " end"), (None, text(4)),  # null ids alone
        (5, text(5)), (5, text(6)), (4, text(5) + " end"),  # an id that stands twice, one of them linked
        (7, text(7)), (7, text(7)),  # equal rows
    ]
    got = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert collections.Counter((x.doc_id, x.text) for x in got if not (x.text or "").startswith("t4")) == collections.Counter([(1, text(1)), (None, text(2)), (None, text(3)), (None, None), (None, ""), (5, text(6)), (4, text(5) + " end"), (7, text(7))])
    assert len([x for x in got if (x.text or "").startswith("t4")]) == 1
