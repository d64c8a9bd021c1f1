"""Evaluation tables: collect, reshape, roll up and compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom import fixed_values as fixed
from corpusloom.functions.text import fixed_point
from corpusloom.operators.skew import sized_join

MAX_METRICS = 5_000


def to_long(wide: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """One row per model and metric. Scores may be stored as text; a text that is no number is a missing score."""
    numbers = wide.select(model, *[F.col(m).try_cast("double").alias(m) for m in metrics])
    return numbers.unpivot([model], metrics, "metric", "score")


def to_wide(long: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """One column per metric; the metric names are given, so no pass is spent to find them."""
    return long.groupBy(model).pivot("metric", metrics).agg(F.first("score", ignorenulls=True))


def metric_names(long: DataFrame, most: int = MAX_METRICS) -> list[str]:
    """All metric names in order, found by a distributed pass. They become columns, so more than ``most`` are an error."""
    names = [r[0] for r in long.where(F.col("metric").isNotNull()).select("metric").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} metrics: keep the long table")
    return sorted(names)


def collect_objects(read: DataFrame) -> DataFrame:
    """Rows ``(model, metric, value)`` of score files with any keys as one row per model, columns the union of the keys.

    A text that is no number is a missing score; a model without keys keeps its row.
    """
    long = read.select("model", "metric", F.col("value").try_cast("double").alias("score"))
    return to_wide(long, "model", metric_names(long))


def collect_scores(parts: list[DataFrame]) -> DataFrame:
    """Score tables with differing columns as one table over the union of the columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def roll_up(long: DataFrame, model: str, categories: dict[str, list[str]] = fixed.SCORE_CATEGORIES) -> DataFrame:
    """Mean per category and AVR, the mean of the categories, in one aggregation."""
    means = [F.avg(F.when(F.col("metric").isin(metrics), F.col("score"))).alias(name) for name, metrics in categories.items()]
    total = reduce(lambda a, b: a + b, [F.col(c) for c in categories]) / len(categories)
    return long.groupBy(model).agg(*means).withColumn("AVR", total)


def flat_average(long: DataFrame, model: str) -> DataFrame:
    return long.groupBy(model).agg(F.avg("score").alias("average"), F.count("score").alias("metrics"))


def csv_line(columns: list[str]) -> Column:
    """Values with 4 places, joined by commas; a missing value leaves its place empty."""
    return F.concat_ws(",", *[F.coalesce(fixed_point(F.col(c)), F.lit("")) for c in columns])


def impute_mean(long: DataFrame) -> DataFrame:
    """Missing scores take the mean of their metric over all models. One mean per metric is joined back, instead of
    a window that would gather all models of a metric in one task."""
    means = long.groupBy("metric").agg(F.avg("score").alias("_mean"))
    joined = sized_join(long, means, ["metric"], "left", ["model", "metric"])
    return joined.withColumn("score", F.coalesce("score", "_mean")).drop("_mean")


def clamp(score: Column) -> Column:
    """Floor at zero; a missing score stays missing."""
    return F.when(score < 0, F.lit(0.0)).otherwise(score)


def offset_from_baseline(long: DataFrame, baseline: str, model: str = "model") -> DataFrame:
    """Difference to the baseline model's metric; the baseline itself is dropped."""
    base = long.where(F.col(model) == baseline).select("metric", F.col("score").alias("_base"))
    others = long.where(F.col(model) != baseline)
    joined = sized_join(others, base, ["metric"], "left", [model, "metric"])
    return joined.select(model, "metric", (F.col("score") - F.col("_base")).alias("offset"))


def mean_of_values(values: DataFrame, column: str) -> DataFrame:
    """Mean, its text with 4 places, and the number of values."""
    return values.agg(F.avg(column).alias("mean"), F.count(column).alias("n")).withColumn("shown", fixed_point(F.col("mean")))
