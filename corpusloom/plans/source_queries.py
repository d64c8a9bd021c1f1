"""Registered queries: sources and sinks, each a round trip through a fresh folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import chat
from corpusloom.operators import conversations as conv_ops
from corpusloom.operators import scores, upsert
from corpusloom.plans import merge_queries, score_queries, views
from corpusloom.plans.oracle_views import with_views
from corpusloom.session import fresh_folder
from corpusloom.sources import keyed, readers, resume, writers

CHUNK = 50
ROWS_PER_LOG = 1000
PARTS = 16
DOCUMENT = "doc_id long, text string, lang string"
WIDE = ", ".join(f"{m} double" for m in views.METRICS)


def _docs(spark, d):
    return views.table(spark, d, "documents")


def src_parquet_pruned(spark, d):
    return readers.parquet_text(spark, f"{d}/documents.parquet", ["text"])


def src_jsonl_multi(spark, d):
    path = fresh_folder(spark, "jsonl")
    writers.write_json(_docs(spark, d).select("doc_id", "text", "lang", "source"), path, partition_by=["source"])
    return readers.json_lines(spark, [f"{path}/source=*/*.json"], DOCUMENT)


def src_jsonl_gz(spark, d):
    path = fresh_folder(spark, "gz")
    writers.write_json(_docs(spark, d).select("doc_id", "text", "lang"), path, gzip=True)
    return readers.json_lines(spark, f"{path}/*.json.gz", DOCUMENT)


def src_json_objects(spark, d):
    """One score object per model and file; the model comes back from the path."""
    path = fresh_folder(spark, "objects")
    writers.write_json(score_queries.scores_wide(spark, d), path, partition_by=["model"])
    return scores.collect_objects(readers.json_key_values(spark, f"{path}/model=*/*.json", r"model=([^/]+)/"))


def scores_collect_files(spark, d):
    """Score files whose keys differ from model to model, as one table over all keys found."""
    path = fresh_folder(spark, "keys")
    writers.write_json(score_queries.scores_collect(spark, d), path, partition_by=["model"])
    return scores.collect_objects(readers.json_key_values(spark, f"{path}/model=*/*.json", r"model=([^/]+)/"))


def src_json_string_array(spark, d):
    """One array of up to CHUNK texts per file, in document order."""
    path = fresh_folder(spark, "arrays")
    texts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    files = (
        _docs(spark, d).groupBy(F.floor(F.col("doc_id") / CHUNK).alias("chunk"))
        .agg(F.to_json(F.transform(texts, lambda t: t["text"])).alias("value")).select("value")
    )
    writers.write_text(files, path, rows_per_file=1)
    return readers.json_array(spark, path).select(F.col("pos").cast("long").alias("pos"), "item")


def src_delimited_scores(spark, d):
    path = fresh_folder(spark, "tsv")
    writers.write_csv(score_queries.scores_wide(spark, d), path, "\t")
    return readers.delimited_scores(spark, path, f"model string, {WIDE}")


def src_regex_metrics(spark, d):
    path = fresh_folder(spark, "logs")
    writers.write_text(views.log_lines(spark, d).select("log"), path, rows_per_file=ROWS_PER_LOG)
    return readers.accuracies(readers.log_pieces(spark, path), "log", [])


def snk_parquet(spark, d):
    path = fresh_folder(spark, "parquet")
    writers.write_parquet(_docs(spark, d).select("doc_id", "text"), path)
    return spark.read.parquet(path)


def snk_json(spark, d):
    path = fresh_folder(spark, "records")
    corpus = views.corpus_arrays(spark, d)
    writers.write_json(conv_ops.bilingual_records(corpus, F.col("id"), F.concat("id", F.lit("-ja"))), path)
    back = readers.json_lines(spark, path, f"id string, conversations {chat.CONVERSATION}")
    return back.select("id", F.to_json("conversations").alias("conversations"))


def snk_csv_scores(spark, d):
    path = fresh_folder(spark, "csv")
    writers.write_csv(score_queries.scores_wide(spark, d), path)
    return readers.delimited_scores(spark, path, f"model string, {WIDE}", ",")


def snk_skip_if_present(spark, d):
    """The second write finds the folder and does nothing."""
    path = fresh_folder(spark, "once")
    docs = _docs(spark, d).select("doc_id", "lang")
    writers.write_if_absent(docs, path)
    writers.write_if_absent(docs.withColumn("lang", F.lit("other")), path)
    return spark.read.parquet(path)


def snk_resumed(spark, d):
    """A write that was stopped after three of its parts, and the run that finishes it."""
    path = fresh_folder(spark, "resumed")
    docs = _docs(spark, d).select("doc_id", "lang")
    stamp = resume.input_stamp(spark, f"{d}/documents.parquet")
    resume.write_parts(docs, path, "doc_id", stamp, only=range(3))
    resume.write_resumable(docs, path, "doc_id", stamp)
    return resume.read_published(spark, path)


def replace_in_place(spark, d):
    """Replaced and new rows written into a table laid out by key: only the touched parts are rewritten."""
    path = fresh_folder(spark, "keyed")
    keyed.write_keyed(views.records(spark, d), path, "id", PARTS)
    keyed.merge_keyed(spark, path, views.incoming(spark, d), "id", "seq", upsert.replace_rows, PARTS)
    return keyed.read_keyed(spark, path)


QUERIES = {f.__name__: f for f in (
    src_parquet_pruned, src_jsonl_multi, src_jsonl_gz, src_json_objects, src_json_string_array, src_delimited_scores,
    src_regex_metrics, snk_parquet, snk_json, snk_csv_scores, snk_skip_if_present,
    scores_collect_files, snk_resumed, replace_in_place,
)}

WIDE_SQL = score_queries.ORACLE["scores_wide"]

ORACLE = {
    "src_parquet_pruned": "SELECT text FROM documents",
    "src_jsonl_multi": "SELECT doc_id, text, lang FROM documents",
    "src_jsonl_gz": "SELECT doc_id, text, lang FROM documents",
    "src_json_objects": WIDE_SQL,
    "src_json_string_array": f"""SELECT row_number() OVER (PARTITION BY doc_id // {CHUNK} ORDER BY doc_id) - 1 AS pos, text AS item FROM documents""",
    "src_delimited_scores": WIDE_SQL,
    "src_regex_metrics": with_views(["accs"], "SELECT acc FROM accs"),
    "snk_parquet": "SELECT doc_id, text FROM documents",
    "snk_json": with_views(["corpus"], """SELECT id, conversation AS conversations FROM corpus
  UNION ALL SELECT id || '-ja', conversation_ja FROM corpus WHERE conversation_ja IS NOT NULL"""),
    "snk_csv_scores": WIDE_SQL,
    "scores_collect_files": score_queries.ORACLE["scores_collect"],
    "snk_resumed": "SELECT doc_id, lang FROM documents",
    "replace_in_place": merge_queries.ORACLE["replace_last_wins"],
    "snk_skip_if_present": "SELECT doc_id, lang FROM documents",
}
