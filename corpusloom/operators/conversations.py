"""Conversation reshaping.

The working form is one row per turn: ``(id, idx, from, value)``. Joins, counts and checks run on turn rows. Only
`assemble` gathers a conversation into one array, where the result is one record per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fixed
from corpusloom.functions import chat
from corpusloom.functions.text import hash32, seeded, text_key
from corpusloom.operators.skew import salted_join


def assemble(turns: DataFrame, id: str = "id", value: str = "value", keep: Column | None = None) -> DataFrame:
    """One record per conversation: all its turns in ``idx`` order. With ``keep``, only where it holds for every turn.

    A record is one row by definition, so a conversation has to fit one; what needs no record works on turn rows.
    """
    item = F.struct("idx", "from", F.col(value).alias("value"))
    grouped = turns.groupBy(id).agg(
        F.array_sort(F.collect_list(item)).alias("_turns"),
        (F.every(keep) if keep is not None else F.lit(True)).alias("_keep"),
    )
    plain = F.transform("_turns", lambda t: chat.turn(t["from"], t["value"]))
    return grouped.where(F.col("_keep")).select(id, plain.alias("conversation"))


def explode_turns(df: DataFrame, id: str = "id", column: str = "conversation") -> DataFrame:
    """One row per turn, numbered from 0."""
    return df.select(id, F.posexplode(column).alias("idx", "_t")).select(id, "idx", "_t.from", "_t.value")


def first_answers(turns: DataFrame, id: str = "id") -> DataFrame:
    """The first answer of each conversation, null where there is none; one partial aggregation, no turns gathered."""
    place = F.when(F.col("from").isin("gpt", "assistant"), F.col("idx"))
    return turns.groupBy(id).agg(F.min_by("value", place).alias("text"))


def bilingual_records(df: DataFrame, id_en: Column, id_ja: Column,
                      en: str = "conversation", ja: str = "conversation_ja") -> DataFrame:
    """Up to two records per row; a missing side gives none."""
    sides = F.array(
        F.struct(id_en.alias("id"), F.col(en).alias("conversations")),
        F.struct(id_ja.alias("id"), F.col(ja).alias("conversations")),
    )
    present = F.filter(sides, lambda s: s["conversations"].isNotNull())
    return df.select(F.inline(present))


def translation_pairs(pairs: DataFrame, en: str, ja: str, seed: int | str = 42) -> DataFrame:
    """Each pair as an EN to JA and a JA to EN task; both ids share the pair's hash."""
    pair_id = F.md5(F.col(en))
    into_ja = chat.draw(fixed.INTO_JAPANESE, seeded(f"{seed}|ja", pair_id))
    into_en = chat.draw(fixed.INTO_ENGLISH, seeded(f"{seed}|en", pair_id))
    tasks = F.array(
        F.struct(
            F.concat(F.lit("translate-en-ja-"), pair_id).alias("id"),
            chat.triple(F.lit(fixed.SYSTEM_EN), F.concat_ws("\n", into_ja, F.col(en)), F.col(ja)).alias("conversations"),
        ),
        F.struct(
            F.concat(F.lit("translate-ja-en-"), pair_id).alias("id"),
            chat.triple(F.lit(fixed.SYSTEM_JA_PAIRS), F.concat_ws("\n", into_en, F.col(ja)), F.col(en)).alias("conversations"),
        ),
    )
    return pairs.select(F.inline(tasks))


def combined_export(df: DataFrame, id_en: Column, id_ja: Column, pairs: DataFrame, en: str, ja: str) -> DataFrame:
    """Records of both languages and the translation tasks of the text pairs as one table ``(id, conversations)``. No shuffle."""
    return bilingual_records(df, id_en, id_ja).unionByName(translation_pairs(pairs, en, ja))


def complete_with_response(stubs: DataFrame, responses: DataFrame) -> DataFrame:
    """Two-turn stubs ``(id, system, prompt)`` completed by the cached response to the prompt: of several, the smallest."""
    keyed = responses.groupBy(text_key(F.col("prompt")).alias("_text")).agg(F.min("response").alias("response"))
    joined = salted_join(stubs.withColumn("_text", text_key(F.col("prompt"))), keyed, ["_text"], "inner", ["id"])
    return joined.select("id", chat.triple(F.col("system"), F.col("prompt"), F.col("response")).alias("conversation"))


def task_chats(tasks: DataFrame) -> DataFrame:
    """One eval task to a JA chat and an EN chat; an empty user side gives none."""
    def side(lang: str) -> Column:
        turns = F.array(chat.turn("system", F.col(f"prompt_{lang}")), chat.turn("user", F.col(f"user_{lang}")))
        return F.struct(F.lit(lang).alias("lang"), F.col(f"user_{lang}").alias("user"), turns.alias("chat"))

    sides = F.filter(F.array(side("ja"), side("en")), lambda s: F.coalesce(s["user"], F.lit("")) != "")
    return tasks.select("id", "type", F.explode(sides).alias("_s")).select("id", "type", "_s.lang", "_s.chat")


def run_grid(models: DataFrame, model: str, temperatures: list[str], repetitions: int) -> DataFrame:
    """Every model with every temperature and repetition, and the name of the output file."""
    grid = (
        models.select(model)
        .withColumn("temperature", F.explode(F.array(*map(F.lit, temperatures))))
        .withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    )
    base = F.element_at(F.split(F.col(model), "/"), -1)
    name = F.concat(F.lit("gen/"), base, F.lit("_temp-"), "temperature", F.lit("_run-"), F.col("run").cast("string"), F.lit(".json"))
    return grid.withColumn("output_file", name)


def order_hash(seed: int | str, key: Column) -> Column:
    return hash32(seeded(seed, key))
