"""Registered queries: filters and work queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import chat
from corpusloom.operators import filters
from corpusloom.plans import oracle_views as o
from corpusloom.plans import views
from corpusloom.plans.oracle_views import with_views

LONG_CHARS = 2000
SUBSET = ["src3", "src0", "src7"]


def _queue(df):
    return df.select("id", "category", F.length("conversation").cast("long").alias("chars"))


def pending_queue(spark, d):
    return filters.shortest_first(filters.pending(views.corpus(spark, d))).select("id", "category", "chars")


def pending_by_category(spark, d):
    return _queue(filters.pending(views.corpus(spark, d), ["multiturn", "roleplay", "writing"]))


def long_rows_queue(spark, d):
    return filters.long_rows(views.corpus(spark, d), LONG_CHARS).select("id", "category", "translator")


def drop_leak_marker(spark, d):
    corpus = views.corpus_arrays(spark, d).where(F.col("conversation_ja").isNotNull())
    return corpus.where(~chat.any_turn_contains(F.col("conversation_ja"), "日本")).select("id", "category")


def task_prompt_filter(spark, d):
    """How many prompts are kept and skipped, per first failing reason, and how many characters they hold."""
    marked = views.prompts(spark, d).withColumn("kept", filters.is_plain_prompt(F.col("prompt")))
    return marked.groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("prompt")).cast("long").alias("chars"))


def task_prompt_kept(spark, d):
    return views.prompts(spark, d).where(filters.is_plain_prompt(F.col("prompt"))).select("doc_id")


def score_threshold(spark, d):
    return views.prefs(spark, d).where("score_chosen >= 9").select("seq", "prompt", "score_chosen")


def min_length_pairs(spark, d):
    return filters.long_pairs(views.pairs(spark, d), "en").select("doc_id")


def code_like_filter(spark, d):
    return views.pairs(spark, d).where(~filters.looks_like_code(F.col("ja"))).select("doc_id")


def blank_input_filter(spark, d):
    return filters.without_input(views.instructions(spark, d)).select("id", "input")


def warning_filter(spark, d):
    return filters.with_warning(views.layers(spark, d))


def named_subset(spark, d):
    picked = filters.named_models(views.scores_long(spark, d), SUBSET)
    return picked.select("model", "metric", F.round("score", 9).alias("score"), F.col("place").cast("long").alias("place"))


def translated_rows(spark, d):
    return filters.translated(views.corpus(spark, d)).select("id", "category", "translator", "conversation_ja")


QUERIES = {f.__name__: f for f in (
    pending_queue, pending_by_category, long_rows_queue, drop_leak_marker, task_prompt_filter, task_prompt_kept,
    score_threshold, min_length_pairs, code_like_filter, blank_input_filter, warning_filter, named_subset, translated_rows,
)}

PLAIN = f"""(NOT contains(prompt, 'translat') AND NOT coalesce(length(prompt) / nullif(strlen(prompt), 0) <= 0.95, false)
  AND {o.count_re('prompt', r'[\p{L}\p{N}_]{15,}')} < 7)"""
CODE = " OR ".join(
    [f"contains(ja, '{m}')" for m in ("```", "{", "std::", "#include")] + [rf"regexp_matches(ja, '(^|[{o.SPACE}])def | in range\(')"]
)

ORACLE = {
    "pending_queue": with_views(["corpus"], """SELECT id, category, length(conversation) AS chars FROM corpus
  WHERE category <> 'mathjson' AND conversation_ja IS NULL ORDER BY chars, id"""),
    "pending_by_category": with_views(["corpus"], """SELECT id, category, length(conversation) AS chars FROM corpus
  WHERE category IN ('multiturn', 'roleplay', 'writing') AND conversation_ja IS NULL"""),
    "long_rows_queue": with_views(["corpus"], f"""SELECT id, category, translator FROM corpus
  WHERE category <> 'mathjson' AND translator <> 'gpt-4' AND length(conversation_ja) >= {LONG_CHARS}"""),
    "drop_leak_marker": with_views(["corpus"], "SELECT id, category FROM corpus WHERE conversation_ja IS NOT NULL AND NOT contains(conversation_ja, '日本')"),
    "task_prompt_filter": with_views(["prompts"], f"SELECT {PLAIN} AS kept, count(*) AS n, sum(length(prompt))::BIGINT AS chars FROM prompts GROUP BY 1"),
    "task_prompt_kept": with_views(["prompts"], f"SELECT doc_id FROM prompts WHERE {PLAIN}"),
    "score_threshold": with_views(["prefs"], "SELECT seq, prompt, score_chosen FROM prefs WHERE score_chosen >= 9"),
    "min_length_pairs": with_views(["pairs"], "SELECT doc_id FROM pairs WHERE length(en) > 2000"),
    "code_like_filter": with_views(["pairs"], f"SELECT doc_id FROM pairs WHERE NOT ({CODE})"),
    "blank_input_filter": with_views(["instructions"], "SELECT id, input FROM instructions WHERE trim(coalesce(input, '')) = ''"),
    "warning_filter": with_views(["layers"], "SELECT * FROM layers WHERE warning <> ''"),
    "named_subset": with_views(["scores_long"], f"""SELECT model, metric, round(score, 9) AS score, list_position({o.listing(SUBSET)}, model)::BIGINT AS place
  FROM scores_long WHERE model IN ({', '.join(map(o.text, SUBSET))})"""),
    "translated_rows": with_views(["corpus"], "SELECT id, category, translator, conversation_ja FROM corpus WHERE category <> 'mathjson' AND conversation_ja IS NOT NULL"),
}
