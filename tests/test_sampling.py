import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import hash32, seeded
from corpusloom.operators import ranking, sampling


def h32(value):
    return int(hashlib.md5(value.encode()).hexdigest()[:8], 16)


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id")).repartition(8)
    rows = ranking.global_rank(df, ["k"]).collect()
    assert all(r["rank"] == r["k"] + 1 for r in rows) and len(rows) == 1000


@pytest.mark.parametrize("n", [0, 1, 7, 300, 5000])
def test_hash_cut_per_group_with_a_hot_group(spark, n):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, source string").repartition(4)
    got = {tuple(r) for r in ranking.first_by_hash(df, n, hash32(seeded(1, F.col("id"))), "id", ["source"]).collect()}
    want = set()
    for source in {s for _, s in rows}:
        ids = sorted((i for i, s in rows if s == source), key=lambda i: (h32(f"1|{i}"), i))
        want |= {(i, source) for i in ids[:n]}
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 50, 899, 900, 2000])
def test_hash_cut_of_the_whole(spark, n):
    df = spark.range(900).repartition(4)
    got = {r["id"] for r in sampling.sample_n(df, n, "id", 42).collect()}
    assert got == set(sorted(range(900), key=lambda i: (h32(f"42|{i}"), i))[:n])


def test_equal_hashes_fall_back_to_the_key(spark):
    df = spark.range(100).withColumn("h", F.lit(5).cast("long"))
    cut = ranking.cut_by_hash(df, [], "h", "id", 30)
    assert sorted(r["id"] for r in ranking.apply_cut(df, cut, [], ["h", "id"], ["id"]).collect()) == list(range(30))


def test_head_fraction(spark):
    rows = [(i, "hot" if i < 400 else f"s{i % 7}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, source string").repartition(5)
    got = {tuple(r) for r in sampling.head_fraction(df, 0.05, "source", "id").collect()}
    want = set()
    for source in {s for _, s in rows}:
        ids = sorted(i for i, s in rows if s == source)
        want |= {(i, source) for i in ids[:math.floor(len(ids) * 0.05)]}
    assert got == want


@pytest.mark.parametrize("n", [1, 10, 1000])
def test_head_n(spark, n):
    df = spark.range(500).repartition(4)
    assert sorted(r["id"] for r in sampling.head_n(df, n, "id").collect()) == list(range(min(n, 500)))


DOCS = [(0, "The cat sat. The cat!"), (1, "a dog ran"), (2, ""), (3, "the cat and the dog"), (4, "zebra zebra zebra")]
TARGET = [(0, "the cat sat on the mat"), (1, "cat cat")]


def grams(text):
    tokens = re.findall(r"\w+|[^\w\s]", text.lower())
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def weights(docs, target, buckets):
    raw = Counter(h32(g) % buckets for _, t in docs for g in grams(t))
    tgt = Counter(h32(g) % buckets for _, t in target for g in grams(t))
    if not target:
        return {i: 0 for i, _ in docs}
    def ratio(b):
        return round((math.log((tgt[b] + 1) / (sum(tgt.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets))) * 1e6)
    return {i: sum(ratio(h32(g) % buckets) for g in grams(t)) for i, t in docs}


@pytest.mark.parametrize("target", [TARGET, []])
def test_dsir_against_brute_force(spark, target):
    schema = "id long, text string"
    raw, tgt = spark.createDataFrame(DOCS, schema), spark.createDataFrame(target, schema)
    ratios = sampling.log_ratios(raw, tgt, "id", "text", "id", "text", 50)
    got = {r["id"]: r["micro"] for r in sampling.importance_weights(raw, ratios, "id", "text", 50).collect()}
    want = weights(DOCS, target, 50)
    assert got == want
    def noise(i):
        return round(-math.log(-math.log((h32(f"42|{i}") + 0.5) / 2**32)) * 1e6)
    best = sorted(want, key=lambda i: (-(want[i] + noise(i)), i))
    for n in (1, 3, 10):
        drawn = sampling.resample(raw, tgt, "id", "text", "id", "text", n, 42, 50)
        assert {r["id"] for r in drawn.collect()} == set(best[:n])


def test_texts_are_hashed_once(spark):
    """Weights and draws from hashed rows equal brute force; texts are neither cut again nor is there a row a gram to be joined."""
    schema = "id long, text string"
    raw = spark.createDataFrame([*DOCS, (5, None), (6, "one")], schema)
    grams_of = sampling.hashed(raw, "id", "text", 50)
    target = grams_of.where("id in (0, 4, 5)")
    ratios = sampling.log_ratios(grams_of, target, "id", "text", "id", "text", 50)
    weighed = sampling.importance_weights(grams_of, ratios, "id", "text", 50)
    plain = [*DOCS, (5, ""), (6, "one")]
    want = weights(plain, [plain[0], plain[4], plain[5]], 50)
    assert {r["id"]: r["micro"] for r in weighed.collect()} == want
    plan = weighed._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "md5" not in plan
    drawn = sampling.resample(raw, target, "id", "text", "id", "text", 3, 42, 50, grams=grams_of)
    again = sampling.resample(raw, raw.where("id in (0, 4, 5)"), "id", "text", "id", "text", 3, 42, 50)
    assert sorted(drawn.collect()) == sorted(again.collect()) and drawn.count() == 3
    long = sampling.resample(raw, target, "id", "text", "id", "text", 9, 42, 50, min_chars=12)
    assert {r["id"] for r in long.collect()} == {0, 3, 4}


def test_ngram_features(spark):
    df = spark.createDataFrame(DOCS, "id long, text string")
    got = {(r["id"], r["bucket"]): r["n"] for r in sampling.ngram_features(df, "id", "text", 50).collect()}
    assert got == dict(Counter((i, h32(g) % 50) for i, t in DOCS for g in grams(t)))


def test_many_equal_weights(spark):
    """A third of the documents share one weight; the draw still equals a full sort."""
    w = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 1000).cast("long").alias("micro"))
    got = {r["id"] for r in sampling.resample_keys(w, "id", 700, 1).collect()}
    scored = w.withColumn("s", F.col("micro") + sampling.gumbel_micro(1, F.col("id")))
    assert got == {r["id"] for r in scored.orderBy(F.desc("s"), "id").limit(700).collect()}


def test_split_is_stable(spark):
    df = spark.range(5000)
    held = {r["id"] for r in df.where(sampling.is_validation(F.col("id"))).collect()}
    assert held == {i for i in range(5000) if h32(f"42|{i}") % 100 < 1}
    assert held == {r["id"] for r in df.repartition(7).where(sampling.is_validation(F.col("id"))).collect()}


def test_concat_sources_and_files(spark):
    a = spark.createDataFrame([("x", 1)], "text string, n int")
    b = spark.createDataFrame([("s1", "y"), ("s2", "z"), ("s3", "w")], "source string, text string")
    assert sorted(r["text"] for r in sampling.concat_sources([a, b]).collect()) == ["w", "x", "y", "z"]
    picked = {r["source"] for r in sampling.sample_sources(b, 2, "source").collect()}
    assert picked == set(sorted(["s1", "s2", "s3"], key=lambda s: h32(f"42|{s}"))[:2])


def test_null_group_is_capped(spark):
    rows = [(i, [None, "a", "b"][i % 3], f"text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    capped = sampling.cap_per_source(docs, 10, "source", "doc_id")
    assert {r["source"]: r["count"] for r in capped.groupBy("source").count().collect()} == {None: 10, "a": 10, "b": 10}
