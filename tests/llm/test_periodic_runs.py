"""Periodic runs against plain scans for every period, and the texts without their repeats."""

import re
import zlib

import numpy as np
import pytest

from marisma.llm import periodic_runs, queries


def plain(words, times=4, least=6):
    """All runs (start, length, period), by start, then period."""
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            s = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, times * q) and not any(a <= s and i + q <= a + n for a, n, p in found if p < q):
                found.append((s, i - s + q, q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, count):
    r = np.random.default_rng(seed)
    for _ in range(count):
        n, x = int(r.integers(0, 100)), []
        while len(x) < n:
            root = [f"w{k}" for k in r.integers(0, r.integers(1, 6), r.integers(1, 9))]
            x += (root * int(r.integers(1, 9)))[: int(r.integers(1, 60))]
        yield x


def test_against_every_period(spark):
    rows = [(i, " ".join(w)) for i, w in enumerate(texts(13, 400))]
    got = {r.doc_id: r for r in periodic_runs.collapse_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    some = 0
    for i, text in rows:
        words = text.split()
        want = plain(words)
        some += len(want)
        assert [tuple(x) for x in got[i].runs] == want and got[i].n_words == len(words)
        assert got[i].collapsed == collapsed(words, want)
    assert some > 300


def test_other_limits(spark):
    rows = [(i, " ".join(w)) for i, w in enumerate(texts(5, 100))]
    got = periodic_runs.collapse_runs(spark.createDataFrame(rows, "doc_id bigint, text string"), times=5, least=12).collect()
    assert all([tuple(x) for x in r.runs] == plain(rows[r.doc_id][1].split(), 5, 12) for r in got)
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(spark.createDataFrame(rows, "doc_id bigint, text string"), times=2)


def test_awkward(spark):
    long = " ".join(f"a{i % 5000}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "é ß é ß é ß é ß é"), (5, long), (6, "x " * 200_000), (7, "A a A a A a"), (8, "a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a")]
    table = spark.createDataFrame([(i, t, "z", 7, "r") for i, t in rows], "doc_id bigint, text string, runs string, n_words int, collapsed string")
    got = periodic_runs.collapse_runs(table).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert by[1] == by[2] == by[3] == ([], "")
    assert by[4] == ([(0, 6, 1)], "a") and by[None] == ([(0, 9, 2)], "é ß") and by[7] == ([], "A a A a A a")
    assert by[5] == ([(0, 60000, 5000)], " ".join(long.split()[:5000])) and by[6] == ([(0, 200_000, 1)], "x") and by[8] == ([(0, 6, 1)], "a\xa0a")
    assert periodic_runs.collapse_runs(table.limit(0)).count() == 0


def test_rewritten_texts(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)] + [(None, "a b"), (10, None)]
    got = queries._with_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    for (i, text), r in zip(rows, got, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        assert (r.text or "").split() == w
