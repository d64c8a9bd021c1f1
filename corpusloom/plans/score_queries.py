"""Registered queries: evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import bucket
from corpusloom.operators import scores
from corpusloom.plans import oracle_views as o
from corpusloom.plans import views
from corpusloom.plans.oracle_views import with_views
from corpusloom.sources import readers

PLACES = 9
BASELINE = "src0"


def _wide(spark, d):
    return scores.to_wide(views.scores_long(spark, d), "model", views.METRICS)


def _rounded(df, columns):
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def scores_collect(spark, d):
    """Some models come with quality metrics only; the collected table has all columns."""
    wide = _wide(spark, d)
    partial = bucket(F.col("model"), 2) == 0
    quality = [m for m in views.METRICS if m.endswith("_quality")]
    table = scores.collect_scores([wide.where(~partial), wide.where(partial).select("model", *quality)])
    return _rounded(table, views.METRICS)


def score_rollup(spark, d):
    rolled = scores.roll_up(views.scores_long(spark, d), "model", views.CATEGORY_METRICS)
    return _rounded(rolled, [*views.CATEGORY_METRICS, "AVR"])


def flat_average(spark, d):
    return _rounded(scores.flat_average(views.scores_long(spark, d), "model"), ["average"])


def scores_long_wide(spark, d):
    """Long to wide and back; a missing combination comes back as a missing score."""
    return _rounded(scores.to_long(_wide(spark, d), "model", views.METRICS), ["score"])


def scores_wide(spark, d):
    return _rounded(_wide(spark, d), views.METRICS)


def scores_csv_line(spark, d):
    return _wide(spark, d).select("model", scores.csv_line(views.METRICS).alias("csv_line"))


def impute_column_mean(spark, d):
    long = scores.to_long(_wide(spark, d), "model", views.METRICS)
    return _rounded(scores.impute_mean(long), ["score"])


def clamp_negative(spark, d):
    long = scores.to_long(_wide(spark, d), "model", views.METRICS)
    return _rounded(long.withColumn("score", scores.clamp(F.col("score"))), ["score"])


def offset_from_baseline(spark, d):
    return _rounded(scores.offset_from_baseline(views.scores_long(spark, d), BASELINE), ["offset"])


def mean_extracted_metric(spark, d):
    values = readers.accuracies(views.log_lines(spark, d), "log", ["event_id"])
    return _rounded(scores.mean_of_values(values, "acc"), ["mean"])


QUERIES = {f.__name__: f for f in (
    scores_collect, score_rollup, flat_average, scores_long_wide, scores_wide, scores_csv_line, impute_column_mean,
    clamp_negative, offset_from_baseline, mean_extracted_metric,
)}


def _cell(metric: str, expr: str = "score") -> str:
    return f"max({expr}) FILTER (metric = '{metric}')"


def _pivot(wrap: str = "round({c}, 9)") -> str:
    return ", ".join(f"{wrap.format(c=_cell(m))} AS {m}" for m in views.METRICS)


def _mean(metrics: list[str]) -> str:
    return f"avg(score) FILTER (metric IN ({', '.join(map(o.text, metrics))}))"


MEANS = ", ".join(f"{_mean(m)} AS {c}" for c, m in views.CATEGORY_METRICS.items())
FULL = f"""SELECT g.model, g.metric, s.score FROM (SELECT model, unnest({o.listing(views.METRICS)}) AS metric
  FROM (SELECT DISTINCT model FROM scores_long)) g LEFT JOIN scores_long s ON g.model = s.model AND g.metric = s.metric"""
PARTIAL = ", ".join(
    f"CASE WHEN {o.b('model', 2)} > 0 THEN round({_cell(m)}, 9) END AS {m}" if m.endswith("_toxic") else f"round({_cell(m)}, 9) AS {m}"
    for m in views.METRICS
)
CSV = " || ',' || ".join(f"coalesce({o.fixed4(m)}, '')" for m in views.METRICS)

ORACLE = {
    "scores_collect": with_views(["scores_long"], f"SELECT model, {PARTIAL} FROM scores_long GROUP BY model"),
    "score_rollup": with_views(["scores_long"], f"""SELECT model, round("MC", 9) AS "MC", round("NLI", 9) AS "NLI", round("QA", 9) AS "QA",
  round("RC", 9) AS "RC", round(("MC" + "NLI" + "QA" + "RC") / 4, 9) AS "AVR" FROM (SELECT model, {MEANS} FROM scores_long GROUP BY model)"""),
    "flat_average": with_views(["scores_long"], "SELECT model, round(avg(score), 9) AS average, count(score) AS metrics FROM scores_long GROUP BY model"),
    "scores_long_wide": with_views(["scores_long"], f"SELECT model, metric, round(score, 9) AS score FROM ({FULL})"),
    "scores_wide": with_views(["scores_long"], f"SELECT model, {_pivot()} FROM scores_long GROUP BY model"),
    "scores_csv_line": with_views(["scores_long"], f"SELECT model, {CSV} AS csv_line FROM (SELECT model, {_pivot('{c}')} FROM scores_long GROUP BY model)"),
    "impute_column_mean": with_views(["scores_long"], f"""SELECT model, metric,
  round(coalesce(score, avg(score) OVER (PARTITION BY metric)), 9) AS score FROM ({FULL})"""),
    "clamp_negative": with_views(["scores_long"], f"SELECT model, metric, round(CASE WHEN score < 0 THEN 0 ELSE score END, 9) AS score FROM ({FULL})"),
    "offset_from_baseline": with_views(["scores_long"], f"""SELECT a.model, a.metric, round(a.score - b.score, 9) AS "offset"
  FROM scores_long a LEFT JOIN scores_long b ON a.metric = b.metric AND b.model = '{BASELINE}' WHERE a.model <> '{BASELINE}'"""),
    "mean_extracted_metric": with_views(["accs"], f"SELECT round(mean, 9) AS mean, n, {o.fixed4('mean')} AS shown FROM (SELECT avg(acc) AS mean, count(acc) AS n FROM accs)"),
}
