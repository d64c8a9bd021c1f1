"""Registered queries: keys, upserts and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import chat
from corpusloom.functions.text import bucket, uuid5
from corpusloom.operators import upsert
from corpusloom.plans import oracle_views as o
from corpusloom.plans import views
from corpusloom.plans.oracle_views import with_views


def ingest_first_wins(spark, d):
    """All incoming rows into an empty table: the first row of an id stands."""
    empty = views.records(spark, d).where("false")
    return upsert.insert_new(empty, views.incoming(spark, d), "id", "seq")


def insert_ignore(spark, d):
    return upsert.insert_new(views.records(spark, d), views.incoming(spark, d), "id", "seq")


def replace_last_wins(spark, d):
    return upsert.replace_rows(views.records(spark, d), views.incoming(spark, d), "id", "seq")


def _half_filled(spark, d):
    """A target whose rows are filled, null, empty or under another id."""
    prompt = F.col("prompt")
    k = bucket(views.tag("side", prompt), 4)
    left = F.when(k == 0, "kept").when(k == 2, "")
    id = F.when(k == 3, uuid5(F.concat(F.lit("other "), prompt))).otherwise(uuid5(prompt))
    return views.prefs(spark, d).select(id.alias("id"), F.lit("prefs").alias("source"), left.alias("conversation")).distinct()


def fill_if_null_upsert(spark, d):
    best = views.prefs(spark, d).where("score_chosen >= 9").select(
        "seq", uuid5(F.col("prompt")).alias("id"), F.lit("prefs").alias("source"), F.col("chosen").alias("conversation")
    )
    return upsert.fill_empty(_half_filled(spark, d), best, "id", "seq", "conversation")


def match_by_content_upsert(spark, d):
    """Incoming conversations without the leak marker meet stored ones of the same content under other ids."""
    known = views.corpus_arrays(spark, d)
    target = known.select(
        F.concat(F.lit("t"), "id").alias("id"), F.lit("first").alias("source"),
        F.when(bucket(F.col("id"), 2) == 0, F.to_json("conversation")).alias("conversation"),
        F.lit(None).cast("string").alias("conversation_ja"),
    )
    clean = known.where(F.col("conversation_ja").isNotNull() & ~chat.any_turn_contains(F.col("conversation_ja"), "日本"))
    batch = clean.select(
        F.col("id").cast("long").alias("seq"), "id", F.lit("second").alias("source"),
        F.to_json("conversation").alias("conversation"), F.to_json("conversation_ja").alias("conversation_ja"),
    )
    return upsert.match_content(target, batch, "conversation", "conversation_ja", "id", "seq")


def merge_translation_caches(spark, d):
    full = views.cache(spark, d)
    right = F.when(bucket(F.col("prompt_en"), 2) == 0, F.concat(F.lit("old "), "prompt_ja"))
    cache = full.select("prompt_en", right.alias("prompt_ja")).where("prompt_ja IS NOT NULL")
    other = full.select("prompt_en", F.when(bucket(F.col("prompt_en"), 3) > 0, F.col("prompt_ja")).alias("prompt_ja"))
    return upsert.merge_caches(cache, other, "prompt_en", "prompt_ja")


def update_by_id(spark, d):
    corpus = views.corpus(spark, d).select("id", "category", "conversation_ja", "translator")
    updates = views.incoming(spark, d).select(
        "seq", "id", F.col("conversation").alias("conversation_ja"), F.lit("late-model").alias("translator")
    )
    return upsert.update_by_key(corpus, updates, "id", "seq", ["conversation_ja", "translator"])


def uuid5_key(spark, d):
    return views.table(spark, d, "documents").select("doc_id", uuid5(F.col("text")).alias("uuid"))


def md5_key(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))


QUERIES = {f.__name__: f for f in (
    ingest_first_wins, insert_ignore, replace_last_wins, fill_if_null_upsert, match_by_content_upsert,
    merge_translation_caches, update_by_id, uuid5_key, md5_key,
)}

FIRST = """SELECT id, arg_min(category, seq) AS category, arg_min(conversation, seq) AS conversation FROM incoming GROUP BY id"""
LAST = FIRST.replace("arg_min", "arg_max")

ORACLE = {
    "ingest_first_wins": with_views(["incoming"], FIRST),
    "insert_ignore": with_views(["incoming"], f"SELECT * FROM records UNION ALL SELECT * FROM ({FIRST}) WHERE id NOT IN (SELECT id FROM records)"),
    "replace_last_wins": with_views(["incoming"], f"""SELECT * FROM records WHERE id NOT IN (SELECT id FROM incoming) UNION ALL {LAST}"""),
    "fill_if_null_upsert": with_views(["prefs"], """SELECT coalesce(t.id, b.id) AS id, coalesce(t.source, b.source) AS source,
  coalesce(nullif(t.conversation, ''), b.conversation, t.conversation) AS conversation FROM target t FULL JOIN best b ON t.id = b.id""", {
        "target": f"""SELECT DISTINCT CASE WHEN k = 3 THEN {o.uuid5("('other ' || prompt)")} ELSE {o.uuid5('prompt')} END AS id,
  'prefs' AS source, CASE k WHEN 0 THEN 'kept' WHEN 2 THEN '' END AS conversation
  FROM (SELECT prompt, {o.b("'side|' || prompt", 4)} AS k FROM prefs)""",
        "best": f"""SELECT id, 'prefs' AS source, arg_min(chosen, seq) AS conversation
  FROM (SELECT seq, chosen, {o.uuid5('prompt')} AS id FROM prefs WHERE score_chosen >= 9) GROUP BY id""",
    }),
    "match_by_content_upsert": with_views(["corpus"], """SELECT t.id, 'first' AS source, t.conversation, m.ja AS conversation_ja
  FROM target t LEFT JOIN merged m ON t.id = (SELECT min(u.id) FROM target u WHERE u.conversation = m.conversation)
  UNION ALL SELECT m.id, 'second', m.conversation, m.ja FROM merged m
  WHERE m.conversation NOT IN (SELECT conversation FROM target WHERE conversation IS NOT NULL)""", {
        "target": f"""SELECT 't' || id AS id, CASE WHEN {o.b('id', 2)} = 0 THEN conversation END AS conversation FROM corpus""",
        "merged": """SELECT conversation, arg_min(id, id::BIGINT) AS id, arg_max(conversation_ja, id::BIGINT) AS ja FROM corpus
  WHERE conversation_ja IS NOT NULL AND NOT contains(conversation_ja, '日本') GROUP BY conversation""",
    }),
    "merge_translation_caches": with_views(["cache"], f"""SELECT prompt_en,
  CASE WHEN {o.b('prompt_en', 2)} = 0 THEN 'old ' || prompt_ja ELSE prompt_ja END AS prompt_ja
  FROM cache WHERE {o.b('prompt_en', 2)} = 0 OR {o.b('prompt_en', 3)} > 0"""),
    "update_by_id": with_views(["corpus", "incoming"], """SELECT c.id, c.category, coalesce(u.ja, c.conversation_ja) AS conversation_ja,
  CASE WHEN u.id IS NULL THEN c.translator ELSE 'late-model' END AS translator
  FROM corpus c LEFT JOIN (SELECT id, arg_max(conversation, seq) AS ja FROM incoming GROUP BY id) u ON c.id = u.id"""),
    "uuid5_key": f"SELECT doc_id, {o.uuid5('text')} AS uuid FROM documents",
    "md5_key": "SELECT doc_id, md5(text) AS md5 FROM documents",
}
