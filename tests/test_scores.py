"""Published score rows as golden values; the model names do not matter."""

import pytest
from pyspark.sql import functions as F

from corpusloom import fixed_values as fixed
from corpusloom.operators import scores

METRICS = ["jamp_exact_match", "janli_exact_match", "jcommonsenseqa_exact_match", "jemhopqa_char_f1", "jnli_exact_match",
           "jsem_exact_match", "jsick_exact_match", "jsquad_char_f1", "jsts_pearson", "jsts_spearman", "niilc_char_f1"]
# Published average and the eleven metrics of seven models.
ROWS = [
    ("m1", 0.7118, 0.3900, 0.9600, 0.8500, 0.4759, 0.8200, 0.7100, 0.7700, 0.8557, 0.8576, 0.8537, 0.2868),
    ("m2", 0.7660, 0.5800, 0.9900, 0.8800, 0.5241, 0.8900, 0.7800, 0.7600, 0.8818, 0.8930, 0.8817, 0.3654),
    ("m3", 0.7320, 0.4800, 0.9900, 0.8400, 0.4682, 0.8300, 0.7200, 0.7500, 0.8810, 0.8847, 0.8750, 0.3330),
    ("m4", 0.6881, 0.3500, 0.9300, 0.8400, 0.4594, 0.7700, 0.7000, 0.6900, 0.8582, 0.8450, 0.8150, 0.3114),
    ("m5", 0.5215, 0.4700, 0.6000, 0.7300, 0.4733, 0.1700, 0.7500, 0.2500, 0.8603, 0.4925, 0.4333, 0.5068),
    ("m6", 0.7402, 0.4900, 0.9400, 0.9400, 0.5037, 0.7200, 0.7500, 0.7000, 0.8839, 0.8934, 0.8216, 0.4999),
    ("m7", 0.5227, 0.3900, 0.5300, 0.8200, 0.4691, 0.1800, 0.5900, 0.2300, 0.8528, 0.6302, 0.6010, 0.4562),
]


@pytest.fixture(scope="module")
def long(spark):
    schema = "model string, avg double, " + ", ".join(f"{m} double" for m in METRICS)
    return scores.to_long(spark.createDataFrame(ROWS, schema), "model", METRICS)


def test_flat_average(long):
    got = {r["model"]: round(r["average"], 4) for r in scores.flat_average(long, "model").collect()}
    assert got == {r[0]: r[1] for r in ROWS}


def test_roll_up(long):
    row = scores.roll_up(long.where("model = 'm2'"), "model").first()
    published = {"AVR": 0.7516, "MC": 0.88, "NLI": 0.8, "QA": 0.4447, "RC": 0.8818}
    assert all(abs(row[c] - v) < 1.1e-4 for c, v in published.items())
    assert set(fixed.SCORE_CATEGORIES) == {"MC", "NLI", "QA", "RC"}


def test_csv_line_and_text_scores(spark):
    wide = spark.createDataFrame([("m", "0.7516", "0.8800", None)], "model string, a string, b string, c string")
    numbers = scores.to_wide(scores.to_long(wide, "model", ["a", "b", "c"]), "model", ["a", "b", "c"])
    assert numbers.select(scores.csv_line(["a", "b", "c"])).first()[0] == "0.7516,0.8800,"


def test_offsets(long):
    family = long.where(F.col("model").isin("m1", "m2", "m4"))
    got = {(r["model"], r["metric"]): round(r["offset"], 4) for r in scores.offset_from_baseline(family, "m1").collect()}
    assert len(got) == 22 and ("m1", "jsts_pearson") not in got
    assert got["m2", "jamp_exact_match"] == 0.19 and got["m4", "niilc_char_f1"] == 0.0246


def test_impute_and_clamp(spark):
    rows = [("a", "x", 1.0), ("b", "x", 3.0), ("c", "x", None), ("c", "y", -1.0)]
    df = spark.createDataFrame(rows, "model string, metric string, score double")
    filled = {(r["model"], r["metric"]): r["score"] for r in scores.impute_mean(df).collect()}
    assert filled["c", "x"] == 2.0 and filled["c", "y"] == -1.0
    clamped = {(r["model"], r["metric"]): r["s"] for r in df.withColumn("s", scores.clamp(F.col("score"))).collect()}
    assert clamped["c", "y"] == 0.0 and clamped["c", "x"] is None


def test_collect_union_of_columns(spark):
    a = spark.createDataFrame([("m1", 1.0)], "model string, x double")
    b = spark.createDataFrame([("m2", 2.0, 3.0)], "model string, y double, x double")
    assert {tuple(r) for r in scores.collect_scores([a, b]).select("model", "x", "y").collect()} == {("m1", 1.0, None), ("m2", 3.0, 2.0)}
