"""Views that bring the given tables into the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import chat
from corpusloom.functions.text import bucket, uuid5
from corpusloom.operators import conversations as conv_ops
from corpusloom.operators import translation
from corpusloom.operators.sampling import BROADCAST_KEYS
from corpusloom.operators.skew import sized_join
from corpusloom.sources.readers import spread

# System lines for the test conversations.
SYSTEM_POOL = [
    "You are a patient tutor.",
    "You answer in one short paragraph.",
    "You are a careful editor.",
    "You only reply with facts.",
    "You are a cheerful guide.",
]
CATEGORIES = ["general", "mathjson", "multiturn", "roleplay", "writing", "coding"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (number + 1).cast("int"))


def tag(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}|"), key.cast("string"))


def ja(text: Column) -> Column:
    """Stand-in translation: vowels become kana, so that bytes and scripts change."""
    return F.translate(text, "aeiou", "あえいおう")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, idx, from, value), roles user/assistant/system."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("idx"),
        F.col("role").alias("from"), F.col("text").alias("value"),
    )


def sys_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a system turn from the pool put first. Turn 0 brings it along, so nothing is shuffled."""
    def row(idx: Column, role: Column, value: Column) -> Column:
        return F.struct(idx.alias("idx"), role.alias("from"), value.alias("value"))

    own = row(F.col("idx") + 1, F.col("from"), F.col("value"))
    pool = row(F.lit(0).cast("long"), F.lit("system"), pick(SYSTEM_POOL, bucket(F.col("id"), 5)))
    rows = F.when(F.col("idx") == 0, F.array(pool, own)).otherwise(F.array(own))
    return turns(spark, sf_dir).select("id", F.inline(rows))


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_ops.assemble(turns(spark, sf_dir))


def sys_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_ops.assemble(sys_turns(spark, sf_dir))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_en, prompt_ja, translator): absent, right, unchanged, cut short or marked, by hash."""
    texts = sys_turns(spark, sf_dir).select(F.col("value").alias("prompt_en")).distinct()
    k = bucket(tag("cache", F.col("prompt_en")), 10)
    whole = ja(F.col("prompt_en"))
    output = (
        F.when(k <= 6, whole).when(k == 7, F.col("prompt_en"))
        .when(k == 8, F.substring(whole, F.lit(1), F.floor(F.length("prompt_en") / 10).cast("int")))
        .otherwise(F.concat(whole, F.lit(" 日本")))
    )
    name = F.when(k >= 5, "short-model").otherwise("gpt-4")
    return texts.where(k > 0).select("prompt_en", output.alias("prompt_ja"), name.alias("translator"))


def good_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache rows that pass the gate."""
    return cache(spark, sf_dir).where(translation.gate(F.col("prompt_en"), F.col("prompt_ja")) == "ok")


def category(id: Column) -> Column:
    return pick(CATEGORIES, bucket(id, 6))


def translator(id: Column) -> Column:
    return (
        F.when(bucket(tag("tr", id), 7) == 0, F.lit(None))
        .when(bucket(tag("tr", id), 2) == 0, "gpt-4").otherwise("short-model")
    )


def corpus_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category, conversation, conversation_ja, translator) with turn arrays."""
    source = sys_turns(spark, sf_dir)
    done = translation.translate_conversations(source, cache(spark, sf_dir)).withColumnRenamed(
        "conversation", "conversation_ja"
    )
    return (
        conv_ops.assemble(source).join(done, "id", "left")
        .select("id", category(F.col("id")).alias("category"), "conversation", "conversation_ja",
                translator(F.col("id")).alias("translator"))
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with JSON text columns."""
    return corpus_arrays(spark, sf_dir).withColumns(
        {"conversation": F.to_json("conversation"), "conversation_ja": F.to_json("conversation_ja")}
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category, conversation) rows, JSON text."""
    return conv(spark, sf_dir).select(
        "id", category(F.col("id")).alias("category"), F.to_json("conversation").alias("conversation")
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, id, category, conversation): known and new ids, some of either repeated later with changed text."""
    number = F.col("id").cast("long")
    changed = F.replace("conversation", F.lit('"value":"'), F.lit('"value":"v2 '))

    def row(seq: Column, id: Column, kind: Column, text: Column) -> Column:
        return F.struct(seq.alias("seq"), id.alias("id"), kind.alias("category"), text.alias("conversation"))

    new_id = F.when(number % 3 == 2, F.concat(F.lit("x"), "id")).otherwise(F.col("id"))
    plain = row(number * 2, new_id, F.col("category"), F.col("conversation"))
    repeat = row(number * 2 + 1, new_id, F.lit("revised"), changed)
    rows = F.when(number % 3 == 1, F.array(plain)).otherwise(F.array(plain, repeat))
    return records(spark, sf_dir).select(F.inline(rows))


CODE_TAILS = [" {x}", " def f", " std::", "\n#include", " in range(", " ```", "\u3000def f", "\u00a0def f", "\u3000in range"]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, en, ja): documents and their stand-in translations; one in five ends in code."""
    key = F.col("doc_id").cast("string")
    code = F.when(bucket(key, 5) == 0, pick(CODE_TAILS, bucket(tag("code", key), len(CODE_TAILS)))).otherwise("")
    return documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("en"), F.concat(ja(F.col("text")), code).alias("ja")
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, prompt) in lower case; one in six asks for a translation."""
    ask = F.when(bucket(F.col("doc_id").cast("string"), 6) == 0, " Translate this").otherwise("")
    return documents(spark, sf_dir).select("doc_id", F.lower(F.concat("text", ask)).alias("prompt"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, refusal) for a quarter of the turn texts."""
    return (
        turns(spark, sf_dir).select("value").distinct().where(bucket(F.col("value"), 4) == 0)
        .select(uuid5(F.col("value")).alias("id"), (bucket(F.col("value"), 20) == 0).alias("refusal"))
    )


def verdicts_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, refusal) for half of the cached translations, one in sixteen a refusal."""
    k = bucket(tag("verdict", F.col("prompt_en")), 16)
    return cache(spark, sf_dir).where(k < 8).select(uuid5(F.col("prompt_ja")).alias("id"), (k == 0).alias("refusal"))


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = bucket(F.col("value"), 4)
    reply = F.when(k == 0, "Yes.").when(k == 1, " no").when(k == 2, "")
    return turns(spark, sf_dir).select("id", "idx", reply.alias("response"))


def first_of(rows: DataFrame, role: str, name: str) -> DataFrame:
    """(id, name): the first text of a role, by partial aggregation."""
    return rows.where(F.col("from") == role).groupBy("id").agg(F.min_by("value", "idx").alias(name))


def prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, prompt, chosen, score_chosen) with chosen as JSON text."""
    return (
        first_of(turns(spark, sf_dir), "user", "prompt").join(conv(spark, sf_dir), "id")
        .select(F.col("id").cast("long").alias("seq"), "prompt", F.to_json("conversation").alias("chosen"),
                (bucket(F.col("prompt"), 10) + 1).cast("double").alias("score_chosen"))
    )


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, instruction, input, output); the input is null, empty, blank or text."""
    rows = turns(spark, sf_dir)
    k = bucket(F.col("id"), 4)
    extra = F.when(k == 1, "").when(k == 2, "  ").when(k == 3, F.concat(F.lit("Case "), "id"))
    return first_of(rows, "user", "instruction").join(first_of(rows, "assistant", "output"), "id").select(
        "id", "instruction", extra.alias("input"), "output"
    )


def multiple_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, input, A, B, C, D, target): a benchmark text with four part names."""
    items = table(spark, sf_dir, "benchmark")
    slot = F.explode(F.sequence(F.lit(0), F.lit(3)))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_key"), "p_name")
    options = (
        items.select("item_id", slot.alias("_slot")).withColumn("_key", F.col("item_id") * 4 + F.col("_slot"))
        .join(names, "_key", "left").groupBy("item_id")
        .agg(*[F.max(F.when(F.col("_slot") == i, F.col("p_name"))).alias(c) for i, c in enumerate("ABCD")])
    )
    target = pick(list("ABCD"), bucket(F.col("item_id").cast("string"), 4))
    return items.join(options, "item_id").select(
        "item_id", F.col("text").alias("input"), "A", "B", "C", "D", target.alias("target")
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, passage, question, spans): documents with a benchmark question and their first three words."""
    items = table(spark, sf_dir, "benchmark")
    count = items.agg(F.count(F.lit(1))).scalar()
    questions = items.select(F.col("item_id").alias("_item"), F.col("text").alias("question"))
    # cut from the head that holds them, not from all words of the text
    head = F.regexp_extract("text", r"^(?:[ \t\n\r\f]*+[^ \t\n\r\f]++){0,3}", 0)
    words = F.regexp_extract_all(head, F.lit(r"[^ \t\n\r\f]+"), 0)
    docs = documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("passage"), words.alias("spans"), (F.col("doc_id") % count).alias("_item")
    )
    return sized_join(docs, questions, ["_item"], "inner", ["doc_id"]).drop("_item")


def labeled(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents with a good quality label: the DSIR target. ``docs`` may give rows made of the documents instead.

    Up to BROADCAST_KEYS counted ids (16 bytes each) go to the documents, so that these are filtered where they lie at every size.
    """
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    if good.count() <= BROADCAST_KEYS:
        good = F.broadcast(good)
    return (documents(spark, sf_dir) if docs is None else docs).join(good, "doc_id", "left_semi")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, prompt_en, prompt_ja, user_en, user_ja); some sides are empty."""
    key = F.col("id")
    first = first_of(turns(spark, sf_dir), "user", "user")
    prompt = pick(SYSTEM_POOL, bucket(key, 5))
    return first.select(
        "id", category(key).alias("type"), prompt.alias("prompt_en"), ja(prompt).alias("prompt_ja"),
        F.when(bucket(tag("en", key), 25) == 0, "").otherwise(F.col("user")).alias("user_en"),
        F.when(bucket(tag("ja", key), 13) == 0, "").otherwise(ja(F.col("user"))).alias("user_ja"),
    )


LANGS = ["de", "en", "es", "fr"]
METRICS = [f"{lang}_{kind}" for lang in LANGS for kind in ("quality", "toxic")]
CATEGORY_METRICS = {
    "MC": ["en_quality"],
    "NLI": ["en_toxic", "fr_quality", "fr_toxic", "de_quality"],
    "QA": ["de_toxic", "es_quality"],
    "RC": ["es_toxic"],
}


def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, metric, score): mean labels by source and language, less 0.1, so that some are negative."""
    labels = table(spark, sf_dir, "labels")
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(labels, "doc_id")
    kinds = F.array(*[
        F.struct(F.concat("lang", F.lit(f"_{kind}")).alias("metric"), F.col(kind).alias("mark")) for kind in ("quality", "toxic")
    ])
    return (
        joined.select(F.col("source").alias("model"), F.inline(kinds)).groupBy("model", "metric")
        .agg((F.sum("mark") / F.count("mark") - 0.1).alias("score"))
    )


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    warning = F.when(F.col("event_type") == "error", "over-trained").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", "value", warning.alias("warning"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, log): one accuracy block per event, next to lines that must not count."""
    acc = F.concat((F.col("event_id") % 2).cast("string"), F.lit("."), F.lpad((F.col("event_id") % 9973).cast("string"), 4, "0"))
    log = F.concat(F.lit('{"acc": '), acc, F.lit(', "acc_norm": 0.25, "acc_stderr": 0.01, "n": {"acc": 0}}'))
    return table(spark, sf_dir, "events").select("event_id", log.alias("log"))
