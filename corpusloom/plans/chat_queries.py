"""Registered queries: conversation reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import fixed_values as fixed
from corpusloom.functions import chat
from corpusloom.operators import conversations as ops
from corpusloom.operators import filters, translation
from corpusloom.plans import oracle_views as o
from corpusloom.plans import views
from corpusloom.plans.oracle_views import with_views


def conv_assemble(spark, d):
    done = translation.translate_conversations(views.sys_turns(spark, d), views.cache(spark, d))
    return done.select("id", F.size("conversation").cast("long").alias("turns"), F.to_json("conversation").alias("conversation"))


def conv_json_roundtrip(spark, d):
    parsed = views.records(spark, d).select("id", chat.parse(F.col("conversation")).alias("conversation"))
    rows = ops.explode_turns(parsed)
    return rows.select("id", F.col("idx").cast("long").alias("idx"), "from", "value")


def role_to_sharegpt(spark, d):
    """Turn rows to records, roles renamed, one record per side present."""
    corpus = views.corpus_arrays(spark, d)
    renamed = corpus.withColumns({c: chat.to_sharegpt(F.col(c)) for c in ("conversation", "conversation_ja")})
    records = ops.bilingual_records(renamed, F.col("id"), F.concat("id", F.lit("-ja")))
    return records.select("id", F.to_json("conversations").alias("conversations"))


def role_to_chat(spark, d):
    rows = views.sys_conv(spark, d).withColumn("conversation", chat.to_chat(chat.to_sharegpt(F.col("conversation"))))
    return rows.select("id", F.to_json("conversation").alias("conversation"))


def first_assistant_turn(spark, d):
    return ops.first_answers(views.turns(spark, d))


def prompt_concat(spark, d):
    return views.sys_conv(spark, d).select("id", chat.prompt_text(F.col("conversation")).alias("prompt"))


def conv_build(spark, d):
    """Triples from instruction columns, and stubs completed by cached responses."""
    rows = views.instructions(spark, d)
    direct = rows.select("id", chat.triple(F.lit(fixed.SYSTEM_JA_INSTRUCTIONS), F.col("instruction"), F.col("output")).alias("conversation"))
    responses = views.cache(spark, d).select(F.col("prompt_en").alias("prompt"), F.col("prompt_ja").alias("response"))
    stubs = rows.select(F.concat(F.lit("stub-"), "id").alias("id"), F.lit(fixed.SYSTEM_EN).alias("system"), F.col("instruction").alias("prompt"))
    both = direct.unionByName(ops.complete_with_response(stubs, responses))
    return both.select("id", F.to_json("conversation").alias("conversation"))


def bilingual_emit(spark, d):
    corpus = filters.translated(views.corpus_arrays(spark, d))
    id = F.concat(F.lit("identity_"), "id")
    records = ops.bilingual_records(corpus, id, F.concat(id, F.lit("_ja")))
    return records.select("id", F.to_json("conversations").alias("conversations"))


def _task_pairs(spark, d):
    return filters.long_pairs(views.pairs(spark, d), "en").where(~filters.looks_like_code(F.col("ja")))


def combined_export(spark, d):
    """The training file: translated conversations in both languages, and long pairs without code as translation tasks."""
    corpus = filters.translated(views.corpus_arrays(spark, d))
    id = F.concat(F.lit("identity_"), "id")
    rows = ops.combined_export(corpus, id, F.concat(id, F.lit("_ja")), _task_pairs(spark, d), "en", "ja")
    return rows.select("id", F.to_json("conversations").alias("conversations"))


def translation_pairs(spark, d):
    tasks = ops.translation_pairs(_task_pairs(spark, d), "en", "ja")
    c = F.col("conversations")
    return tasks.select("id", c[0]["value"].alias("system"), c[1]["value"].alias("human"), c[2]["value"].alias("gpt"))


def instruction_template(spark, d):
    rows = views.instructions(spark, d)
    return rows.select("id", chat.instruction_prompt(F.col("instruction"), F.col("input")).alias("prompt"))


def request_template(spark, d):
    rows = views.turns(spark, d)
    return rows.select(
        "id", "idx", chat.request(fixed.TRANSLATE_REQUEST, F.col("value")).alias("translate"),
        chat.request(fixed.REFUSAL_REQUEST, F.col("value")).alias("refusal"),
    )


def strip_delimiters(spark, d):
    """Documents wrapped in tags in several ways, by hash."""
    k = F.col("doc_id") % 5
    text = F.col("text")
    wrapped = (
        F.when(k == 0, text).when(k == 1, F.concat(F.lit("<<[start]>>\n"), text, F.lit("\n<<[end]>> bye")))
        .when(k == 2, F.concat(F.lit("<[start]> "), text, F.lit(" <[end]>")))
        .when(k == 3, F.concat(F.lit("<<[start]>>"), text)).otherwise(F.concat(text, F.lit("<[end]> rest <<[end]>>")))
    )
    return views.table(spark, d, "documents").select("doc_id", chat.strip_delimiters(wrapped).alias("text"))


STYLES = ["llama-2", "tess", "chatml"]


def chat_render(spark, d):
    c = F.col("conversation")
    rendered = F.array(*[
        F.struct(F.lit(s).alias("style"), chat.render(c, s, answer_cue=True).alias("prompt")) for s in STYLES
    ])
    return views.sys_conv(spark, d).select("id", F.inline(rendered))


def task_fanout(spark, d):
    chats = ops.task_chats(views.tasks(spark, d))
    return chats.select("id", "type", "lang", F.to_json("chat").alias("chat"))


def run_grid(spark, d):
    models = views.table(spark, d, "documents").select(F.concat(F.lit("models/"), "source").alias("model")).distinct()
    grid = ops.run_grid(models, "model", fixed.RUN_TEMPERATURES, fixed.RUN_REPETITIONS)
    return grid.withColumn("run", F.col("run").cast("long"))


QUERIES = {f.__name__: f for f in (
    conv_assemble, conv_json_roundtrip, role_to_sharegpt, role_to_chat, first_assistant_turn, prompt_concat, conv_build,
    bilingual_emit, combined_export, translation_pairs, instruction_template, request_template, strip_delimiters, chat_render,
    task_fanout, run_grid,
)}


def _json(role: str) -> str:
    return f"to_json(list({{'from': {role}, 'value': value}} ORDER BY idx))::VARCHAR"


SHAREGPT = """CASE "from" WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE "from" END"""


def _triple(system: str, human: str, gpt: str) -> str:
    return (f"to_json([{{'from': 'system', 'value': {system}}}, {{'from': 'human', 'value': {human}}}, "
            f"{{'from': 'gpt', 'value': {gpt}}}])::VARCHAR")


def _request(template: str) -> str:
    head, tail = template.split("{text}")
    return f"{o.text(head)} || value || {o.text(tail)}"


def _draw(options: list[str], key: str) -> str:
    return f"{o.listing(options)}[{o.b(key, len(options))} + 1]"


NL = "chr(10)"
STRIP = f"""regexp_replace(replace(replace(CASE WHEN contains(w, '<<[end]>>') THEN split_part(w, '<<[end]>>', 1)
  ELSE split_part(w, '<[end]>', 1) END, '<<[start]>>', ''), '<[start]>', ''), '^[{o.SPACE}]+|[{o.SPACE}]+$', '', 'g')"""

ORACLE = {
    "conv_assemble": with_views(["conv_ja", "turns_ja"], """SELECT j.id, t.n AS turns, j.conversation_ja AS conversation
  FROM conv_ja j JOIN (SELECT id, count(*) AS n FROM sys_turns GROUP BY id) t ON j.id = t.id"""),
    "conv_json_roundtrip": with_views(["turns"], 'SELECT id, idx, "from", value FROM turns'),
    "role_to_sharegpt": with_views(["turns_ja", "conv_ja"], f"""SELECT id, {_json(SHAREGPT)} AS conversations FROM sys_turns GROUP BY id
  UNION ALL SELECT id || '-ja', {_json(SHAREGPT)} FROM turns_ja WHERE id IN (SELECT id FROM conv_ja) GROUP BY id"""),
    "role_to_chat": with_views(["sys_conv"], "SELECT id, conversation FROM sys_conv"),
    "first_assistant_turn": with_views(["turns"], """SELECT id, arg_min(value, idx) FILTER ("from" = 'assistant') AS text FROM turns GROUP BY id"""),
    "prompt_concat": with_views(["sys_turns"], f"""SELECT id, lower(string_agg(value, {NL} ORDER BY idx)) AS prompt
  FROM sys_turns WHERE "from" IN ('user', 'human', 'system') GROUP BY id"""),
    "conv_build": with_views(["instructions", "cache"], f"""SELECT id, {_triple(o.text(fixed.SYSTEM_JA_INSTRUCTIONS), 'instruction', 'output')} AS conversation
  FROM instructions UNION ALL SELECT 'stub-' || id, {_triple(o.text(fixed.SYSTEM_EN), 'instruction', 'prompt_ja')}
  FROM instructions JOIN cache ON instruction = prompt_en"""),
    "bilingual_emit": with_views(["corpus"], """SELECT 'identity_' || id AS id, conversation AS conversations FROM corpus
  WHERE category <> 'mathjson' AND conversation_ja IS NOT NULL
  UNION ALL SELECT 'identity_' || id || '_ja', conversation_ja FROM corpus WHERE category <> 'mathjson' AND conversation_ja IS NOT NULL"""),
    "instruction_template": with_views(["instructions"], f"""SELECT id, {o.text(fixed.INSTRUCTION_HEADER)} || {NL} || {NL} ||
  {o.text(fixed.INSTRUCTION_TITLE)} || {NL} || instruction || {NL} || {NL} ||
  CASE WHEN trim(coalesce(input, '')) = '' THEN '' ELSE {o.text(fixed.INPUT_TITLE)} || {NL} || input END || {NL} || {NL} ||
  {o.text(fixed.ANSWER_TITLE)} AS prompt FROM instructions"""),
    "request_template": with_views(["turns"], f"SELECT id, idx, {_request(fixed.TRANSLATE_REQUEST)} AS translate, {_request(fixed.REFUSAL_REQUEST)} AS refusal FROM turns"),
    "strip_delimiters": f"""WITH wrapped AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text
  WHEN 1 THEN '<<[start]>>' || {NL} || text || {NL} || '<<[end]>> bye' WHEN 2 THEN '<[start]> ' || text || ' <[end]>'
  WHEN 3 THEN '<<[start]>>' || text ELSE text || '<[end]> rest <<[end]>>' END AS w FROM documents)
SELECT doc_id, {STRIP} AS text FROM wrapped""",
    "chat_render": with_views(["sys_turns"], f"""SELECT id, 'llama-2' AS style, string_agg(CASE
    WHEN "from" = 'user' AND idx > 1 THEN '<s>[INST] ' || value || ' [/INST]' WHEN "from" = 'user' THEN value || ' [/INST]'
    WHEN "from" = 'system' THEN '[INST] <<SYS>>' || {NL} || value || {NL} || '<</SYS>>' || {NL} || {NL}
    WHEN "from" = 'assistant' THEN ' ' || value || ' </s>' ELSE '' END, '' ORDER BY idx) AS prompt FROM sys_turns GROUP BY id
  UNION ALL SELECT id, 'tess', string_agg(upper("from") || ': ' || value || {NL}, '' ORDER BY idx) || 'ASSISTANT: ' FROM sys_turns GROUP BY id
  UNION ALL SELECT id, 'chatml', string_agg('<|im_start|>' || "from" || {NL} || value || '<|im_end|>' || {NL}, '' ORDER BY idx)
    || '<|im_start|>assistant' || {NL} FROM sys_turns GROUP BY id"""),
    "task_fanout": with_views(["tasks"], """SELECT id, type, 'ja' AS lang,
  to_json([{'from': 'system', 'value': prompt_ja}, {'from': 'user', 'value': user_ja}])::VARCHAR AS chat FROM tasks WHERE user_ja <> ''
  UNION ALL SELECT id, type, 'en', to_json([{'from': 'system', 'value': prompt_en}, {'from': 'user', 'value': user_en}])::VARCHAR
  FROM tasks WHERE user_en <> ''"""),
    "run_grid": f"""SELECT 'models/' || source AS model, temperature, run,
  'gen/' || source || '_temp-' || temperature || '_run-' || run || '.json' AS output_file
  FROM (SELECT DISTINCT source FROM documents), unnest({o.listing(fixed.RUN_TEMPERATURES)}) t(temperature), range(1, {fixed.RUN_REPETITIONS + 1}) r(run)""",
}

_FROM_PAIRS = " FROM pairs WHERE length(en) > 2000 AND NOT ({code})"


def _pairs_oracle() -> str:
    from corpusloom.plans.filter_queries import CODE

    kept = _FROM_PAIRS.format(code=CODE)
    return with_views(["pairs"], f"""SELECT 'translate-en-ja-' || md5(en) AS id, {o.text(fixed.SYSTEM_EN)} AS system,
  {_draw(fixed.INTO_JAPANESE, "'42|ja|' || md5(en)")} || {NL} || en AS human, ja AS gpt{kept}
  UNION ALL SELECT 'translate-ja-en-' || md5(en), {o.text(fixed.SYSTEM_JA_PAIRS)},
  {_draw(fixed.INTO_ENGLISH, "'42|en|' || md5(en)")} || {NL} || ja, en{kept}""")


ORACLE["translation_pairs"] = _pairs_oracle()
# Each part is a subquery, since it brings its own WITH list.
ORACLE["combined_export"] = f"""SELECT id, conversations FROM ({ORACLE["bilingual_emit"]})
  UNION ALL SELECT id, to_json([{{'from': 'system', 'value': system}}, {{'from': 'human', 'value': human}}, {{'from': 'gpt', 'value': gpt}}])::VARCHAR
  FROM ({ORACLE["translation_pairs"]})"""
