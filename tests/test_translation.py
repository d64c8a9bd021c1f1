import random

from pyspark.sql import functions as F

from corpusloom.functions.text import uuid5
from corpusloom.operators import conversations, skew, translation

TURNS = "id string, idx long, `from` string, value string"
CACHE = "prompt_en string, prompt_ja string, translator string"


def test_salted_join_equals_plain_join(spark):
    rng = random.Random(1)
    left = [(i, None if i % 50 == 0 else ("hot" if i % 3 == 0 else f"k{rng.randrange(40)}")) for i in range(3000)]
    right = [("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)]
    lf, rf = spark.createDataFrame(left, "i long, k string"), spark.createDataFrame(right, "k string, v long")
    for how in ("left", "inner", "left_anti", "left_semi"):
        got = skew.salted_join(lf, rf, ["k"], how, ["i"], hot_rows=500)
        want = lf.join(rf, "k", how)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    hot = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert [tuple(r) for r in skew.hot_keys(lf, ["k"], hot_rows=500).collect()] == [(hot, 2)]


def test_a_key_of_a_million_rows_fills_several_tasks(spark):
    left = spark.range(0, 1_500_000, 1, 8).select("id", F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    right = left.select("k").distinct().withColumn("v", F.length("k"))
    assert skew.hot_keys(left, ["k"], hot_rows=100_000).select("_slices").collect()[0][0] in range(10, 12)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        joined = skew.salted_join(left, right, ["k"], "inner", ["id"], hot_rows=100_000)
        sizes = [r["n"] for r in joined.where("k = 'hot'").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 1_000_000 and len(sizes) >= 5 and max(sizes) < 500_000


def test_source_texts_are_not_shuffled_to_find_translations(spark):
    turns = spark.range(10).selectExpr("cast(id AS string) AS id", "0L AS idx", "'gpt' AS `from`", "concat('long text ', id) AS value")
    cache = spark.range(5).selectExpr("concat('long text ', id) AS prompt_en", "concat('JA', id) AS prompt_ja", "'t' AS translator")
    done = translation.translate_conversations(turns, cache)
    assert sorted(r["conversation"][0]["value"] for r in done.collect()) == [f"JA{i}" for i in range(5)]
    joins = done._jdf.queryExecution().optimizedPlan().toString()
    after = joins[:joins.index("Join LeftOuter, ((_text")]
    assert "value_ja" in after and " value#" not in after and ",value#" not in after


def test_sized_join_beyond_the_limit(spark):
    lf = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("k"))
    rf = spark.range(5).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    small, large = (skew.sized_join(lf, rf, ["k"], "left", ["id"], max_rows=m) for m in (100, 1))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) and small.count() == 100
    assert "_salt" in large._jdf.queryExecution().analyzed().toString()


def test_long_conversation_stays_whole(spark):
    n = 100_001
    turns = spark.range(n, numPartitions=4).selectExpr("'long' AS id", "id AS idx", "'gpt' AS `from`", "cast(id % 7 AS string) AS value")
    assert conversations.assemble(turns).selectExpr("size(conversation) AS n").first()["n"] == n
    cache = spark.createDataFrame([(str(i), f"J{i}", "t") for i in range(7)], CACHE)
    done = translation.translate_conversations(turns, cache)
    assert done.selectExpr("size(conversation) AS n", "conversation[100000].value AS last").collect() == [(n, f"J{(n - 1) % 7}")]


def test_empty_outputs_do_not_hide_a_translation(spark):
    turns = spark.createDataFrame([("c", 0, "human", "hi"), ("c", 1, "gpt", "yo")], TURNS)
    cache = spark.createDataFrame([("hi", "JA1", "t"), ("hi", None, "t"), ("hi", " ", "u"), ("yo", "JA2", "t")], CACHE)
    assert [len(r["conversation"]) for r in translation.translate_conversations(turns, cache).collect()] == [2]


def test_refusal_wins_over_other_verdicts(spark):
    from corpusloom.functions.text import uuid5
    from pyspark.sql import functions as F

    turns = spark.createDataFrame([("a", 0, "gpt", "x"), ("b", 0, "gpt", "y"), ("c", 0, "gpt", "z")], TURNS)
    verdicts = spark.createDataFrame([("x", True), ("x", None), ("y", False), ("y", True), ("z", None)], "t string, refusal boolean").select(uuid5(F.col("t")).alias("id"), "refusal")
    got = {r["id"]: r["verdict"] for r in translation.check_refusals(turns, verdicts, ["id", "idx"]).collect()}
    assert got == {"a": "refused", "b": "refused", "c": "check"}


def test_refused_translations_drop_their_conversation(spark):
    from corpusloom.functions.text import uuid5
    from pyspark.sql import functions as F

    turns = spark.createDataFrame([("a", 0, "human", "x"), ("a", 1, "gpt", "y"), ("b", 0, "human", "x"), ("c", 0, "gpt", "z"), ("d", 0, "gpt", "none"), ("e", 0, "gpt", "w")], TURNS)
    cache = spark.createDataFrame([("x", "X", "t"), ("y", "no", "t"), ("z", "maybe", "t"), ("w", "W", "t")], CACHE)
    verdicts = spark.createDataFrame([("no", True), ("X", False), ("w", True), ("W", None)], "t string, refusal boolean").select(uuid5(F.col("t")).alias("id"), "refusal")
    done = translation.translate_without_refusals(turns, cache, verdicts)
    assert {r["id"] for r in done.collect()} == {"b", "c", "e"}


def test_one_response_per_prompt(spark):
    stubs = spark.createDataFrame([("a", "s", "p")], "id string, system string, prompt string")
    responses = spark.createDataFrame([("p", "r2"), ("p", "r1")], "prompt string, response string")
    assert conversations.complete_with_response(stubs, responses).count() == 1


def test_first_answers(spark):
    turns = spark.createDataFrame([("a", 1, "gpt", "late"), ("a", 0, "assistant", "first"), ("b", 0, "human", "q"), ("c", 0, "gpt", None), ("c", 1, "gpt", "x")], TURNS)
    assert {tuple(r) for r in conversations.first_answers(turns).collect()} == {("a", "first"), ("b", None), ("c", None)}


def test_all_or_nothing(spark):
    turns = spark.createDataFrame([
        ("full", 1, "gpt", "b"), ("full", 0, "human", "a"), ("miss", 0, "human", "a"), ("miss", 1, "gpt", "zz"),
        ("blank", 0, "human", "a"), ("blank", 1, "gpt", "  "), ("null", 0, "human", None), ("empty", 0, "human", "e"),
    ], TURNS)
    cache = spark.createDataFrame([("a", "A", "t"), ("a", "B", "t"), ("b", "BB", "t"), ("  ", "x", "t"), ("e", "", "t")], CACHE)
    done = translation.translate_conversations(turns, cache).collect()
    assert [(r["id"], [tuple(t) for t in r["conversation"]]) for r in done] == [("full", [("human", "A"), ("gpt", "BB")])]


def test_system_only(spark):
    turns = spark.createDataFrame([("c", 0, "system", "s"), ("c", 1, "human", "s"), ("d", 0, "system", "other")], TURNS)
    cache = spark.createDataFrame([("s", "S", "t")], CACHE)
    fresh = spark.createDataFrame([("c", 1, "fresh"), ("d", 0, "new")], "id string, idx long, fresh string")
    rows = {(r["id"], r["idx"]): r["value"] for r in translation.translate_system_only(turns, cache, fresh).collect()}
    assert rows == {("c", 0): "S", ("c", 1): "fresh", ("d", 0): "new"}


def test_request_plan(spark):
    turns = spark.createDataFrame([("c", 0, "human", "a"), ("c", 1, "gpt", "a"), ("c", 2, "human", " "), ("c", 3, "gpt", "b"),
                                   ("c", 4, "human", "l" * 2500)], TURNS)
    cache = spark.createDataFrame([("b", "B", "t")], CACHE)
    rows = {(r["text"][:2], r["model"]) for r in translation.plan_requests(turns, cache).collect()}
    assert rows == {("a", "short"), ("ll", "long")}


def test_refusals(spark):
    turns = spark.createDataFrame([("r", 0, "gpt", "no way"), ("r", 1, "gpt", "fine"), ("k", 0, "gpt", "a\nb\nc"), ("k", 1, "gpt", "x" * 1000),
                                   ("q", 0, "gpt", "short")], TURNS)
    stored = spark.createDataFrame([("no way", True), ("fine", False)], "t string, refusal boolean").select(uuid5(F.col("t")).alias("id"), "refusal")
    checked = translation.check_refusals(turns, stored, ["id", "idx"])
    rows = {r["id"]: (r["dropped"], r["to_check"]) for r in translation.refusal_summary(checked).collect()}
    assert rows == {"r": (True, 0), "k": (False, 0), "q": (False, 1)}
    kept = translation.drop_refused(conversations.assemble(turns), checked)
    assert sorted(r["id"] for r in kept.collect()) == ["k", "q"]


def test_repeated_prompts(spark):
    turns = spark.createDataFrame([("a", 0, "system", "s"), ("b", 0, "system", "s"), ("c", 0, "system", "u"), ("d", 0, "human", "u")], TURNS)
    assert [tuple(r) for r in translation.repeated_prompts(turns).collect()] == [("s", 2)]


def test_bands(spark):
    corpus = spark.createDataFrame([("l", "c", "x"), ("s", "c", "x"), ("z", "c", "x"), ("g", "c", "gpt-4"), ("n", "c", None)], "id string, category string, translator string")
    def side(values):
        return spark.createDataFrame([(k, 0, "gpt", v) for k, v in values.items()], TURNS)
    en = side({"l": "a", "s": "a a a", "z": "", "g": "a", "n": "a"})
    ja = side({"l": "b b b", "s": "b", "z": "b", "g": "b b b", "n": "b b b b"})
    rows = {r["id"]: (r["ratio"], r["band"], r["redo"]) for r in translation.token_ratios(corpus, en, ja, "word").collect()}
    assert rows["l"] == (3.0, "long", True) and rows["z"] == (None, None, False)
    assert rows["g"] == (3.0, "long", False) and rows["n"] == (4.0, "long", False)
    assert rows["s"][1:] == ("short", True)


def test_cost_prices_output_tokens(spark):
    cache = spark.createDataFrame([("a b", "x y z", "t")], CACHE)
    row = translation.cost(cache, "word").first()
    assert (row["tokens_in"], row["tokens_out"]) == (2, 3)
    assert abs(row["cost_in"] - 0.00006) < 1e-12 and abs(row["cost_out"] - 0.00018) < 1e-12


def test_combined_export_holds_records_and_tasks(spark):
    kind = "array<struct<`from`:string,value:string>>"
    corpus = spark.createDataFrame([("a", [("human", "hi")], [("human", "JA")]), ("b", [("human", "yo")], None)],
                                   f"id string, conversation {kind}, conversation_ja {kind}")
    pairs = spark.createDataFrame([("one", "JA1"), ("one", "JA1")], "en string, ja string")
    rows = conversations.combined_export(corpus, F.col("id"), F.concat("id", F.lit("_ja")), pairs, "en", "ja").collect()
    assert sorted(r["id"] for r in rows if not r["id"].startswith("translate-")) == ["a", "a_ja", "b"]
    tasks = [r for r in rows if r["id"].startswith("translate-")]
    assert len(tasks) == 4 and {r["conversations"][2]["value"] for r in tasks} == {"one", "JA1"}
    empty = conversations.combined_export(corpus.where("false"), F.col("id"), F.col("id"), pairs.where("false"), "en", "ja")
    assert empty.count() == 0
