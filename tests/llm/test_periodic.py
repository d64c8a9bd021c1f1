"""Periodic runs against a scan of every lag at every place."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from corpusloom.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    """All lags, all places; the smallest period of each stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def thue_morse(n):
    return [b"%d" % (i.bit_count() % 2) for i in range(n)]


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [
    [b"a"] * 11, [b"a"] * 12, [b"a"] * 100, [b"a", b"b"] * 6, ([b"a", b"b"] * 6)[:-1], [b"x", *[b"a", b"b", b"c"] * 5, b"a", b"y"],
    [*[b"%d" % i for i in range(30)] * 2], [*[b"%d" % i for i in range(30)] * 2][:-1], thue_morse(400), fibonacci(400),
    [*[b"a"] * 40, *[b"a", b"b"] * 30, *[b"b"] * 20], [b"%d" % i for i in range(200)], [*[b"p", b"q", b"r", b"p", b"q"] * 9, *[b"p", b"q", b"r"] * 9],
])
def test_runs(words):
    assert periodic.word_runs(words) == plain_runs(words)


def test_random_runs():
    rng = random.Random(3)
    for _ in range(400):
        words = []
        while len(words) < rng.randrange(1, 160):
            part = [b"%d" % rng.randrange(rng.choice([2, 3, 30])) for _ in range(rng.randrange(1, 12))]
            words += part * rng.randrange(1, 6) + part[: rng.randrange(len(part) + 1)]
        runs = plain_runs(words)
        assert periodic.word_runs(words) == runs
        assert periodic.collapse(words, runs) == plain_collapse(words, runs)


def test_splitting_alone_changes_nothing(monkeypatch):
    rng = random.Random(4)
    texts = [[b"%d" % rng.randrange(6) for _ in range(80)] for _ in range(40)]
    monkeypatch.setattr(periodic, "ROUNDS", 0)
    assert [periodic.word_runs(t) for t in texts] == [plain_runs(t) for t in texts]
    monkeypatch.setattr(periodic, "BLOCKS", 7)
    assert [periodic.word_runs(t) for t in texts] == [plain_runs(t) for t in texts]


def test_long_texts_end_in_time():
    rng, start = random.Random(5), time.process_time()
    page = [b"%d" % rng.randrange(10**6) for _ in range(20_000)]
    assert periodic.word_runs([b"a"] * 300_000) == [(0, 300_000, 1)]
    assert periodic.word_runs(page * 7) == [(0, 140_000, 20_000)]
    for words in (thue_morse(1 << 17), [b"%d" % rng.randrange(2) for _ in range(200_000)]):
        for s, n, q in periodic.word_runs(words):
            assert n >= max(12, 2 * q) and words[s : s + n - q] == words[s + q : s + n]
    assert time.process_time() - start < 60


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), sha(plain_collapse(words, runs)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, SF).select(COLUMNS).collect()]
    small = {i for i, t in docs if len((t or "").split()) < 3000}
    assert len(got) == len(docs)
    assert sorted(r for r in got if r[0] in small) == sorted(plain_row(i, t) for i, t in docs if i in small)
    assert sum(r[1] > 0 for r in got) >= len(docs) // 20


def test_odd_rows(spark):
    """Nulls, empty texts, other white space, repeated rows, clashing columns, no rows."""
    texts = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a\x0bb\x0ca\rb " * 6), (5, "é à " * 9), (5, "é à " * 9), (None, "x y z " * 5),
             (6, "a b\x1fa b " * 9), (7, "word " * 5000)]
    frame = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in texts], "doc_id long, text string, runs int, start int, _h string")
    got = periodic.run_digests(periodic.periodic_runs(frame)).collect()
    key = lambda r: (r[0] is None, *[str(x) for x in r])
    want = []
    for i, t in texts:
        words = (t or "").encode().split()
        runs = plain_runs(words) if len(words) < 4000 else [(0, len(words), 1)]
        want.append((i, len(runs), len(words), hashlib.sha256(plain_collapse(words, runs)).hexdigest()))
    assert sorted(((r.doc_id, r.n_runs, r.n_words, r.collapsed_sha256) for r in got), key=key) == sorted(want, key=key)
    assert periodic.tiled(frame).count() == len(texts)
    assert {r.text for r in periodic.tiled(frame.where("doc_id is null")).collect()} == {"x y z " * 5}
    assert periodic.run_digests(periodic.periodic_runs(frame.limit(0))).count() == 0
    real = periodic.periodic_runs(frame.where("doc_id = 4")).first()
    assert real.collapsed == "a b" and [tuple(r) for r in real.runs] == [(0, 24, 2)]
    assert not re.search(r"\s\s", real.collapsed)


def test_frequent_segments():
    x = np.array([0, 1, 0, 1, 2, 0, 1, 3, 3, 4, 5, 4, 5], np.int64)
    assert sorted(periodic.frequent_segments(x, 2)) == [(0, 4), (7, 9), (9, 13)] or sorted(periodic.frequent_segments(x, 2)) == [(0, 4), (7, 13)]
