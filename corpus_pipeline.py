"""The corpus pipeline: five stages from `documents` to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next. All
but the last keep the columns of `documents`. Rows that share an id but not the text are told apart, but for
``drop_near``, which drops ids; a null id is kept there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, jaccard_join, packing, quality_lm, secret_scan
from corpusloom.llm.common import settle, small_side, table, text_hash, without, without_rows
from corpusloom.llm.queries import vocabulary
from corpusloom.session import fresh_folder

#: Near duplicates in the pipeline: shingles of five words and a similarity of 0.8.
NEAR = jaccard_join.Rule(k=5, percent=80, small=84)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose perplexity is above their language's threshold."""
    judged = quality_lm.classify(docs, table(spark, sf_dir, "labels"))
    return without_rows(docs, judged.where(~F.col("kept")).select("doc_id", "body"), text_hash("text"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; a repeated row stays once."""
    named = exact_dedup.exact_duplicates(docs).groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("stays"), F.count(F.lit(1)).alias("times"))
    named = settle(named.where("not stays or times > 1"))
    own = F.sha2(exact_dedup.one_space(F.col("text")).cast("binary"), 256)
    rest = without_rows(docs, named.where("not stays").select("doc_id", "text_sha256"), own)
    repeated = settle(named.where("stays").select("doc_id", "text_sha256"))
    if repeated.isEmpty():
        return rest
    single = without_rows(rest, repeated, own)
    copies = rest.withColumn("_sha", own).join(small_side(repeated.withColumnRenamed("doc_id", "_id")),
                                              rest["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("text_sha256")), "left_semi")
    return single.unionByName(copies.dropDuplicates(["doc_id", "_sha"]).select(*docs.columns))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked texts."""
    grouped = jaccard_join.near_duplicates(docs, rule=NEAR)
    return without(docs, grouped.where("doc_id <> component_id").select("doc_id"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and `n_chars` counted anew where a text changed."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequences."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact),
    ("jaccard_join", drop_near),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]
#: The trained stages cannot be put in SQL; tests run them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
