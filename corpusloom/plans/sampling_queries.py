"""Registered queries: sampling, splitting, mixing and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import bench_text
from corpusloom.functions.text import bucket
from corpusloom.operators import conversations as conv_ops
from corpusloom.operators import filters, sampling
from corpusloom.plans import oracle_views as o
from corpusloom.plans import views
from corpusloom.plans.oracle_views import with_views

SEED = 42
DRAWN = 100
DRAWN_SMALL = 10
SAMPLE = 120
CAP = 20
FRACTION = 0.05
HEAD = 150


def _docs(spark, d):
    return views.documents(spark, d)


def dsir_ngram_features(spark, d):
    return sampling.ngram_features(_docs(spark, d), "doc_id", "text")


def dsir_importance_weights(spark, d):
    docs = sampling.hashed(_docs(spark, d), "doc_id", "text")
    ratios = sampling.log_ratios(docs, views.table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return sampling.importance_weights(docs, ratios, "doc_id", "text")


def dsir_resample(spark, d):
    docs = _docs(spark, d)
    grams = sampling.hashed(docs, "doc_id", "text")
    target = views.labeled(spark, d, grams)
    drawn = sampling.resample(docs, target, "doc_id", "text", "doc_id", "text", DRAWN, SEED, grams=grams)
    return drawn.select("doc_id", "score", "text")


def seeded_sample_n(spark, d):
    return sampling.sample_n(_docs(spark, d), SAMPLE, "doc_id", SEED).select("doc_id", "text")


def per_source_cap(spark, d):
    return sampling.cap_per_source(_docs(spark, d), CAP, "source", "doc_id", SEED).select("source", "doc_id", "text")


def head_fraction(spark, d):
    return sampling.head_fraction(_docs(spark, d), FRACTION, "source", "doc_id").select("source", "doc_id", "text")


def head_n(spark, d):
    return sampling.head_n(_docs(spark, d), HEAD, "doc_id").select("doc_id", "text")


def file_sample(spark, d):
    return sampling.sample_sources(_docs(spark, d), 2, "source", SEED).select("source", "doc_id", "text")


def concat_sources(spark, d):
    parts = [_docs(spark, d), views.table(spark, d, "benchmark"), views.table(spark, d, "conversations")]
    return sampling.concat_sources(parts)


def _mc_text(df):
    return bench_text.multiple_choice(F.col("input"), bench_text.option_columns(df.columns), F.col("target"))


def mixture_build(spark, d):
    """Drawn documents of both language groups (10:1), capped training rows and benchmark texts of all six layouts, in hash order."""
    docs, target = _docs(spark, d), views.labeled(spark, d)
    grams = sampling.hashed(docs, "doc_id", "text", keep=["lang"])
    good = views.labeled(spark, d, grams)
    parts = []
    for foreign, n in ((True, DRAWN), (False, DRAWN_SMALL)):
        side = (F.col("lang") != "en") if foreign else (F.col("lang") == "en")
        parts.append(sampling.resample(docs.where(side), good.where(side), "doc_id", "text", "doc_id", "text", n, SEED, grams=grams.where(side)))
    parts.append(sampling.cap_per_source(target, CAP, "source", "doc_id", SEED))
    formats = (fmt_multiple_choice_columns, fmt_passage_spans, fmt_definition_io, fmt_question_answer, fmt_option_pick, fmt_choice_arrays)
    parts += [f(spark, d) for f in formats]
    return sampling.concat_sources(parts).sort(conv_ops.order_hash(SEED, F.col("text")))


def train_val_split(spark, d):
    held = sampling.is_validation(F.col("doc_id"), 1, SEED)
    return _docs(spark, d).select("doc_id", F.when(held, "val").otherwise("train").alias("split"))


def fmt_multiple_choice_columns(spark, d):
    mc = views.multiple_choice(spark, d)
    return mc.select("item_id", _mc_text(mc).alias("text"))


def fmt_passage_spans(spark, d):
    text = bench_text.passage_spans(F.col("passage"), F.col("question"), F.col("spans"))
    return views.passages(spark, d).select("doc_id", text.alias("text"))


def fmt_definition_io(spark, d):
    rows = sampling.sample_n(views.passages(spark, d), SAMPLE, "doc_id", SEED)
    return rows.select("doc_id", bench_text.lines(F.col("question"), F.col("passage"), F.array_join("spans", " ")).alias("text"))


def fmt_question_answer(spark, d):
    rows = filters.without_input(views.instructions(spark, d))
    return rows.select("id", bench_text.lines(F.col("instruction"), F.col("output")).alias("text"))


def fmt_option_pick(spark, d):
    answer = bucket(F.col("doc_id").cast("string"), 2) + 1
    spans = F.col("spans")
    text = bench_text.option_pick(F.col("question"), F.try_element_at(spans, F.lit(1)), F.try_element_at(spans, F.lit(2)), answer)
    return views.passages(spark, d).select("doc_id", text.alias("text"))


def fmt_choice_arrays(spark, d):
    mc = views.multiple_choice(spark, d)
    labels = F.array(*map(F.lit, "ABCD"))
    text = bench_text.choice_arrays(F.col("input"), labels, F.array("A", "B", "C", "D"), F.col("target"))
    return mc.select("item_id", text.alias("text"))


QUERIES = {f.__name__: f for f in (
    dsir_ngram_features, dsir_importance_weights, dsir_resample, seeded_sample_n, per_source_cap, head_fraction, head_n,
    file_sample, concat_sources, mixture_build, train_val_split, fmt_multiple_choice_columns, fmt_passage_spans,
    fmt_definition_io, fmt_question_answer, fmt_option_pick, fmt_choice_arrays,
)}

NL = "chr(10)"


def grams(source: str, id: str) -> str:
    return f"""SELECT id, {o.b('gram', sampling.NGRAM_BUCKETS)} AS bucket FROM (SELECT {id} AS id,
  unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram
  FROM (SELECT {id}, {o.tokens('lower(text)', 'word_or_mark')} AS t FROM {source}))"""


def dsir(name: str, raw: str, target: str, raw_id: str = "doc_id", target_id: str = "doc_id") -> dict[str, str]:
    """CTEs up to ``{name}_weights(id, micro)``."""
    n = sampling.NGRAM_BUCKETS
    return {
        f"{name}_raw": grams(raw, raw_id),
        f"{name}_target": grams(target, target_id),
        f"{name}_counts": f"""SELECT bucket, coalesce(r, 0) AS r, coalesce(t, 0) AS t
  FROM (SELECT bucket, count(*) AS r FROM {name}_raw GROUP BY 1) FULL JOIN (SELECT bucket, count(*) AS t FROM {name}_target GROUP BY 1) USING (bucket)""",
        f"{name}_ratios": f"""SELECT bucket, CASE WHEN sum(t) OVER () = 0 THEN 0 ELSE
  round((ln((t + 1) / (sum(t) OVER () + {n})) - ln((r + 1) / (sum(r) OVER () + {n}))) * 1000000)::BIGINT END AS micro FROM {name}_counts""",
        f"{name}_weights": f"""SELECT {raw_id} AS id, coalesce(micro, 0)::BIGINT AS micro FROM {raw} LEFT JOIN
  (SELECT g.id, sum(micro) AS micro FROM {name}_raw g JOIN {name}_ratios USING (bucket) GROUP BY g.id) w ON {raw_id} = w.id""",
        f"{name}_scores": f"""SELECT id, micro + round(-ln(-ln(({o.h(f"'{SEED}|' || id")} + 0.5) / 4294967296.0::DOUBLE)) * 1000000)::BIGINT AS score
  FROM {name}_weights""",
    }


def drawn(name: str, n: int) -> str:
    return f"(SELECT id, score FROM {name}_scores ORDER BY score DESC, id LIMIT {n})"


def ranked(source: str, key: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT *, row_number() OVER ({part}ORDER BY {o.h(f"'{SEED}|' || {key}")}, {key}) AS rn FROM {source}"


CAPPED = f"SELECT * FROM ({ranked('labeled', 'doc_id', 'source')}) WHERE rn <= {CAP}"
MC = " || chr(10) || ".join(["input", "'A. ' || A", "'B. ' || B", "'C. ' || C", "'D. ' || D", "target"])
SPANS = f"passage || {NL} || question || {NL} || array_to_string(spans, ', ')"
DEFINED = f"question || {NL} || passage || {NL} || array_to_string(spans, ' ')"
ANSWERED = f"instruction || {NL} || output"
PICKED = f"question || {NL} || spans[{o.b('doc_id::VARCHAR', 2)} + 1]"

ORACLE = {
    "dsir_ngram_features": f"SELECT id AS doc_id, bucket, count(*) AS n FROM ({grams('documents', 'doc_id')}) GROUP BY ALL",
    "dsir_importance_weights": with_views([], "SELECT id AS doc_id, micro FROM a_weights", dsir("a", "documents", "benchmark", "doc_id", "item_id")),
    "dsir_resample": with_views(["labeled"], f"SELECT doc_id, score, text FROM {drawn('a', DRAWN)} s JOIN documents ON doc_id = s.id",
                                dsir("a", "documents", "labeled")),
    "seeded_sample_n": f"SELECT doc_id, text FROM ({ranked('documents', 'doc_id')}) WHERE rn <= {SAMPLE}",
    "per_source_cap": f"SELECT source, doc_id, text FROM ({ranked('documents', 'doc_id', 'source')}) WHERE rn <= {CAP}",
    "head_fraction": f"""SELECT source, doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn,
  count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rn <= floor(n * {FRACTION}::DOUBLE)""",
    "head_n": f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {HEAD}",
    "file_sample": f"""SELECT source, doc_id, text FROM documents WHERE source IN
  (SELECT source FROM ({ranked('(SELECT DISTINCT source FROM documents)', 'source')}) WHERE rn <= 2)""",
    "concat_sources": "SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM conversations",
    "mixture_build": with_views(["labeled", "mc", "passages", "instructions"], f"""SELECT text FROM {drawn('a', DRAWN)} s JOIN documents ON doc_id = s.id
  UNION ALL SELECT text FROM {drawn('e', DRAWN_SMALL)} s JOIN documents ON doc_id = s.id
  UNION ALL SELECT text FROM ({CAPPED}) UNION ALL SELECT {MC} FROM mc UNION ALL SELECT {SPANS} FROM passages
  UNION ALL SELECT {DEFINED} FROM ({ranked('passages', 'doc_id')}) WHERE rn <= {SAMPLE}
  UNION ALL SELECT {ANSWERED} FROM instructions WHERE trim(coalesce(input, '')) = ''
  UNION ALL SELECT {PICKED} FROM passages UNION ALL SELECT {MC} FROM mc""", {
        "docs_f": "SELECT * FROM documents WHERE lang <> 'en'", "docs_e": "SELECT * FROM documents WHERE lang = 'en'",
        "labeled_f": "SELECT * FROM labeled WHERE lang <> 'en'", "labeled_e": "SELECT * FROM labeled WHERE lang = 'en'",
        **dsir("a", "docs_f", "labeled_f"), **dsir("e", "docs_e", "labeled_e"),
    }),
    "train_val_split": f"SELECT doc_id, CASE WHEN {o.b(f"'{SEED}|' || doc_id", 100)} < 1 THEN 'val' ELSE 'train' END AS split FROM documents",
    "fmt_multiple_choice_columns": with_views(["mc"], f"SELECT item_id, {MC} AS text FROM mc"),
    "fmt_passage_spans": with_views(["passages"], f"SELECT doc_id, {SPANS} AS text FROM passages"),
    "fmt_definition_io": with_views(["passages"], f"""SELECT doc_id, {DEFINED} AS text
  FROM ({ranked('passages', 'doc_id')}) WHERE rn <= {SAMPLE}"""),
    "fmt_question_answer": with_views(["instructions"], f"SELECT id, {ANSWERED} AS text FROM instructions WHERE trim(coalesce(input, '')) = ''"),
    "fmt_option_pick": with_views(["passages"], f"SELECT doc_id, {PICKED} AS text FROM passages"),
    "fmt_choice_arrays": with_views(["mc"], f"SELECT item_id, {MC} AS text FROM mc"),
}
