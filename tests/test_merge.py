from pyspark.sql import functions as F

from corpusloom.operators import upsert


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_first_and_last_win(spark):
    target = spark.createDataFrame([("a", "old")], "id string, v string")
    batch = spark.createDataFrame([(2, "b", "second"), (1, "b", "first"), (3, "a", "new"), (4, "a", "newest")], "seq int, id string, v string")
    assert as_set(upsert.insert_new(target, batch, "id", "seq")) == {("a", "old"), ("b", "first")}
    assert as_set(upsert.replace_rows(target, batch, "id", "seq")) == {("a", "newest"), ("b", "second")}


def test_hot_id_is_reduced_before_the_shuffle(spark):
    batch = spark.range(10_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"))
    one = upsert.first_per_key(batch, ["id"], [F.col("seq")])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert one.count() == 1 + sum(1 for i in range(10_000) if i % 3)
    assert one.where("id = 'hot'").first()["seq"] == 0


def test_fill_empty(spark):
    target = spark.createDataFrame([("n", "s", None), ("e", "s", ""), ("f", "s", "kept"), ("alone", "s", "x")], "id string, source string, c string")
    batch = spark.createDataFrame([(2, "n", "b", "late"), (1, "n", "b", "fill"), (1, "e", "b", "fill"), (1, "f", "b", "no"), (1, "new", "b", "in")],
                                  "seq int, id string, source string, c string")
    assert as_set(upsert.fill_empty(target, batch, "id", "seq", "c")) == {
        ("n", "s", "fill"), ("e", "s", "fill"), ("f", "s", "kept"), ("alone", "s", "x"), ("new", "b", "in")}


def test_match_content(spark):
    schema = "id string, source string, c string, ja string"
    target = spark.createDataFrame([("t1", "s", "same", None), ("t2", "s", "same", None), ("t3", "s", None, "k")], schema)
    batch = spark.createDataFrame([(1, "b1", "b", "same", "one"), (2, "b2", "b", "same", "two"), (3, "b3", "b", "fresh", "x"),
                                   (4, "b4", "b", "fresh", "y"), (5, "b5", "b", None, "z")], f"seq int, {schema}")
    assert as_set(upsert.match_content(target, batch, "c", "ja", "id", "seq")) == {
        ("t1", "s", "same", "two"), ("t2", "s", "same", None), ("t3", "s", None, "k"),
        ("b3", "b", "fresh", "y"), ("b5", "b", None, "z")}


def test_update_by_key(spark):
    target = spark.createDataFrame([("a", "x", "t"), ("b", None, None)], "id string, ja string, tr string")
    updates = spark.createDataFrame([(1, "a", "one", None), (2, "a", "two", None), (1, "zz", "no", "no")], "seq int, id string, ja string, tr string")
    assert as_set(upsert.update_by_key(target, updates, "id", "seq", ["ja", "tr"])) == {("a", "two", "t"), ("b", None, None)}


def test_merge_caches(spark):
    cache = spark.createDataFrame([("a", "1")], "p string, j string")
    other = spark.createDataFrame([("a", "9"), ("b", "2"), ("c", None)], "p string, j string")
    assert as_set(upsert.merge_caches(cache, other, "p", "j")) == {("a", "1"), ("b", "2")}
