"""Registered queries: translation cache, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import fixed_values as fixed
from corpusloom.functions.text import bucket
from corpusloom.operators import filters, translation
from corpusloom.plans import oracle_views as o
from corpusloom.plans import views
from corpusloom.plans.oracle_views import with_views

KIND = "byte"


def repeated_system_prompts(spark, d):
    return translation.repeated_prompts(views.sys_turns(spark, d))


def cache_apply_all_or_nothing(spark, d):
    done = translation.translate_conversations(views.sys_turns(spark, d), views.cache(spark, d))
    return done.select("id", F.to_json("conversation").alias("conversation_ja"))


def cache_apply_without_refusals(spark, d):
    done = translation.translate_without_refusals(views.sys_turns(spark, d), views.cache(spark, d), views.verdicts_ja(spark, d))
    return done.select("id", F.to_json("conversation").alias("conversation_ja"))


def refusal_kept(spark, d):
    """The conversations that the verdicts leave."""
    checked = translation.check_refusals(views.turns(spark, d), views.verdicts(spark, d), ["id", "idx"])
    return translation.drop_refused(views.turns(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("turns")), checked)


def cache_apply_system_only(spark, d):
    turns = views.sys_turns(spark, d)
    fresh = turns.where(F.col("from") != "system").select("id", "idx", views.ja(F.col("value")).alias("fresh"))
    done = translation.translate_system_only(turns, views.cache(spark, d), fresh)
    return done.select("id", F.col("idx").cast("long").alias("idx"), "from", "value")


def request_plan(spark, d):
    return translation.plan_requests(views.sys_turns(spark, d), views.good_cache(spark, d))


def translation_gate(spark, d):
    return views.cache(spark, d).select(
        "prompt_en", translation.gate(F.col("prompt_en"), F.col("prompt_ja")).alias("gate")
    )


def boilerplate_gate(spark, d):
    """A tenth of the outputs echo the request, a tenth are empty."""
    k = bucket(views.tag("echo", F.col("prompt_en")), 10)
    output = F.when(k == 0, F.concat(F.lit(fixed.EMPTY_REQUEST_ECHO), F.lit(" "), "prompt_ja")).when(k == 1, "").otherwise(F.col("prompt_ja"))
    return views.cache(spark, d).select("prompt_en", translation.without_boilerplate(output).alias("prompt_ja"))


def translator_fallback(spark, d):
    """The cached output is the primary one; three in four texts have a secondary one."""
    text = F.col("prompt_en")
    second = F.when(bucket(views.tag("second", text), 4) > 0, views.ja(text))
    picked = translation.pick_translator(text, F.col("prompt_ja"), F.lit("short-model"), second, F.lit("gpt-4"))
    return views.cache(spark, d).select("prompt_en", picked.alias("p")).select("prompt_en", "p.value", "p.translator")


def refusal_filter(spark, d):
    checked = translation.check_refusals(views.turns(spark, d), views.verdicts(spark, d), ["id", "idx"])
    return translation.refusal_summary(checked)


def refusal_turns(spark, d):
    checked = translation.check_refusals(views.turns(spark, d), views.verdicts(spark, d), ["id", "idx"])
    return checked.select("id", "idx", "verdict")


def verdict_parse(spark, d):
    return views.judge_replies(spark, d).select("id", "idx", translation.says_yes(F.col("response")).alias("refusal"))


def _ratios(spark, d):
    turns = views.sys_turns(spark, d)
    corpus = filters.translated(views.corpus_arrays(spark, d))
    found = translation.lookup(turns, views.cache(spark, d), ["id", "idx"])
    turns_ja = found.select("id", "idx", "from", F.coalesce("value_ja", F.lit("")).alias("value"))
    return translation.token_ratios(corpus, turns, turns_ja, KIND)


def token_ratio_bands(spark, d):
    return _ratios(spark, d).withColumn("ratio", F.round("ratio", 9))


def ratio_histogram(spark, d):
    return translation.histogram(_ratios(spark, d), "ratio", 0.05)


def untranslated_by_category(spark, d):
    return filters.pending(views.corpus(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def cost_estimate(spark, d):
    costs = translation.cost(views.cache(spark, d), "word_or_mark")
    return costs.withColumns({c: F.round(c, 6) for c in ("cost_in", "cost_out")})


QUERIES = {f.__name__: f for f in (
    repeated_system_prompts, cache_apply_all_or_nothing, cache_apply_without_refusals, refusal_kept, cache_apply_system_only, request_plan, translation_gate,
    boilerplate_gate, translator_fallback, refusal_filter, refusal_turns, verdict_parse, token_ratio_bands,
    ratio_histogram, untranslated_by_category, cost_estimate,
)}

LINES = r"""(len(regexp_extract_all(value, '\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]'))
  + regexp_matches(value, '[^\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]\z')::INT)"""
CHECKED = f"""SELECT t.id, t.idx, CASE WHEN v.refusal IS NOT NULL THEN CASE WHEN v.refusal THEN 'refused' ELSE 'ok' END
  WHEN {LINES} >= 3 OR length(t.value) >= 1000 THEN 'ok' ELSE 'check' END AS verdict
  FROM turns t LEFT JOIN verdicts v ON {o.uuid5('t.value')} = v.id"""
RATIOS = f"""SELECT id, category, translator, tc, tc_ja, tc_ja / nullif(tc, 0) AS ratio FROM corpus JOIN (
  SELECT id, sum({o.token_count('value_en', KIND)})::BIGINT AS tc, sum({o.token_count("coalesce(value, '')", KIND)})::BIGINT AS tc_ja
  FROM turns_ja GROUP BY id) USING (id) WHERE category <> 'mathjson' AND conversation_ja IS NOT NULL"""

ORACLE = {
    "repeated_system_prompts": with_views(["sys_turns"], """SELECT value AS prompt, count(*) AS n FROM sys_turns WHERE "from" = 'system'
  GROUP BY value HAVING count(*) > 1"""),
    "cache_apply_all_or_nothing": with_views(["conv_ja"], "SELECT * FROM conv_ja"),
    "cache_apply_without_refusals": with_views(["conv_ja", "turns_ja", "verdicts_ja"], f"""SELECT * FROM conv_ja WHERE id NOT IN
  (SELECT t.id FROM turns_ja t JOIN verdicts_ja v ON {o.uuid5('t.value')} = v.id WHERE v.refusal AND NOT {o.blank('t.value')})"""),
    "refusal_kept": with_views(["turns", "verdicts"], f"""SELECT id, count(*) AS turns FROM turns WHERE id NOT IN
  (SELECT id FROM ({CHECKED}) WHERE verdict = 'refused') GROUP BY id"""),
    "cache_apply_system_only": with_views(["turns_ja"], f"""SELECT id, idx, "from",
  CASE WHEN "from" = 'system' THEN nullif(value, '') ELSE {o.ja('value_en')} END AS value FROM turns_ja"""),
    "request_plan": with_views(["cache"], f"""SELECT DISTINCT value AS text,
  CASE WHEN length(value) + {len(fixed.TRANSLATE_REQUEST) - 6} <= 2500 THEN 'short' ELSE 'long' END AS model FROM sys_turns
  WHERE NOT {o.blank('value')} AND value NOT IN (SELECT prompt_en FROM cache WHERE {o.gate('prompt_en', 'prompt_ja')} = 'ok')"""),
    "translation_gate": with_views(["cache"], f"SELECT prompt_en, {o.gate('prompt_en', 'prompt_ja')} AS gate FROM cache"),
    "boilerplate_gate": with_views(["cache"], f"""SELECT prompt_en, CASE WHEN {o.b("'echo|' || prompt_en", 10)} < 2 THEN NULL
  ELSE nullif(prompt_ja, '') END AS prompt_ja FROM cache"""),
    "translator_fallback": with_views(["cache"], f"""SELECT prompt_en,
  CASE WHEN g = 'ok' THEN prompt_ja WHEN s > 0 THEN {o.ja('prompt_en')} END AS value,
  CASE WHEN g = 'ok' THEN 'short-model' WHEN s > 0 THEN 'gpt-4' END AS translator
  FROM (SELECT *, {o.gate('prompt_en', 'prompt_ja')} AS g, {o.b("'second|' || prompt_en", 4)} AS s FROM cache)"""),
    "refusal_filter": with_views(["turns", "verdicts"], f"""SELECT id, bool_or(verdict = 'refused') AS dropped,
  count(*) FILTER (verdict = 'check') AS to_check FROM ({CHECKED}) GROUP BY id"""),
    "refusal_turns": with_views(["turns", "verdicts"], CHECKED),
    "verdict_parse": with_views(["judge_replies"], "SELECT id, idx, coalesce(contains(lower(response), 'yes'), false) AS refusal FROM judge_replies"),
    "token_ratio_bands": with_views(["corpus", "turns_ja"], f"""SELECT id, category, translator, tc, tc_ja, round(ratio, 9) AS ratio,
  CASE WHEN ratio >= 3.0 THEN 'long' WHEN ratio <= 1.0 THEN 'short' END AS band,
  coalesce((ratio >= 3.0 OR ratio < 0.5) AND translator <> 'gpt-4', false) AS redo FROM ({RATIOS})"""),
    "ratio_histogram": with_views(["corpus", "turns_ja"], f"SELECT floor(ratio / 0.05)::BIGINT AS bin, count(*) AS n FROM ({RATIOS}) WHERE ratio IS NOT NULL GROUP BY 1"),
    "untranslated_by_category": with_views(["corpus"], "SELECT category, count(*) AS n FROM corpus WHERE category <> 'mathjson' AND conversation_ja IS NULL GROUP BY 1"),
    "cost_estimate": with_views(["cache"], f"""SELECT translator, i AS tokens_in, u AS tokens_out, round(i / 1000 * 0.03, 6) AS cost_in,
  round(u / 1000 * 0.06, 6) AS cost_out FROM (SELECT translator, sum({o.token_count('prompt_en', 'word_or_mark')})::BIGINT AS i,
  sum({o.token_count('prompt_ja', 'word_or_mark')})::BIGINT AS u FROM cache GROUP BY translator)"""),
}
