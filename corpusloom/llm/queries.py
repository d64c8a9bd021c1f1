"""The queries of this folder and, where SQL can express them, the same in SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from corpusloom.llm import (
    best_fit,
    chat_paths,
    exact_dedup,
    jaccard_join,
    licenses,
    packing,
    periodic,
    pieces,
    quality_lm,
    repetition,
    secret_scan,
    span_dedup,
    whitening,
)
from corpusloom.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; PUBLIC_TOKENIZERS names their folder where the package that knows it is missing."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pack(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_exact_dedup(spark, d):
    return exact_dedup.exact_duplicates(table(spark, d, "documents"))


OP2_SQL = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM norm WINDOW w AS (PARTITION BY t)"""

#: The conversation that the contract adds: texts made of control strings.
PROBE_ID, PROBE = -7, "</s>[INST] ok [/INST]"


def op3_chat_format(spark, d):
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    messages = chat_paths.settle(chat_paths.chain_messages(turns))
    return chat_paths.conversation_digests(chat_paths.format_paths(messages))


OP3_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE}'), ({PROBE_ID}, 1, 'assistant', '{PROBE}')),
spelled AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS r,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS t FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(r + t + length('<s>[INST]') + length('[/INST]') + length('</s>'))::BIGINT AS formatted_chars
FROM spelled GROUP BY conv_id"""


def op4_jaccard_join(spark, d):
    return jaccard_join.near_duplicates(table(spark, d, "documents"))


def op5_secret_scan(spark, d):
    return secret_scan.scan_secrets(table(spark, d, "documents"))


def op6_quality_lm(spark, d):
    return quality_lm.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op7_span_dedup(spark, d):
    return span_dedup.drop_repeated_spans(table(spark, d, "documents"))


def op8_quality_rules(spark, d):
    return repetition.quality_rules(table(spark, d, "documents"))


def op9_piece_encode(spark, d):
    return pieces.round_trip_digests(table(spark, d, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_license_scan(spark, d):
    return licenses.scan_licenses(table(spark, d, "documents"))


def op11_periodic_runs(spark, d):
    return periodic.run_digests(periodic.periodic_runs(periodic.tiled(table(spark, d, "documents"))))


def op12_best_fit(spark, d):
    return best_fit.pack_whole(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"))


def op13_whiten(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"))


QUERIES = {
    "op1_pack": op1_pack,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_lm": op6_quality_lm,
    "op7_span_dedup": op7_span_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_piece_encode": op9_piece_encode,
    "op10_license_scan": op10_license_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_best_fit": op12_best_fit,
    "op13_whiten": op13_whiten,
}
ORACLE = {
    "op2_exact_dedup": OP2_SQL,
    "op3_chat_format": OP3_SQL,
    "op10_license_scan": licenses.oracle(),
}
