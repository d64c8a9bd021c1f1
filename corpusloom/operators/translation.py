"""Translation cache, gates and reports. Model output enters as tables; nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fixed
from corpusloom.functions.text import chars, is_blank, latin_share, line_count, text_key, token_count, utf8_bytes, uuid5
from corpusloom.operators.conversations import assemble
from corpusloom.operators.skew import salted_join
from corpusloom.operators.upsert import first_per_key


def repeated_prompts(turns: DataFrame, role: str = "system") -> DataFrame:
    """Texts of a role that occur more than once, with their counts."""
    return (
        turns.where(F.col("from") == role).groupBy(F.col("value").alias("prompt"))
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


def lookup(turns: DataFrame, cache: DataFrame, spread: list[str], when: Column | None = None) -> DataFrame:
    """Add the cached ``value_ja`` and ``translator`` of each turn text, null where the cache has none.

    Texts meet by ``text_key``, so neither side's source text is shuffled unless the caller uses it afterwards. Null and
    blank outputs count as missing. The cache is reduced to one row per text first, so it cannot multiply turns; a prompt
    that most turns share is salted. ``when`` limits the lookup to some turns.
    """
    filled = cache.where(~is_blank(F.col("prompt_ja"))).select(
        text_key(F.col("prompt_en")).alias("_text"), F.col("prompt_ja").alias("value_ja"), "translator")
    unique = first_per_key(filled, ["_text"], [F.col("value_ja"), F.col("translator")])
    key = text_key(F.col("value"))
    return salted_join(turns.withColumn("_text", key if when is None else F.when(when, key)), unique, ["_text"], "left", spread).drop("_text")


def _looked_up(turns: DataFrame, cache: DataFrame, id: str) -> tuple[DataFrame, Column]:
    """Turns with their translation, and whether a turn has one. What is asked of the source text is settled before the join."""
    found = lookup(turns.withColumn("_blank", is_blank(F.col("value"))), cache, [id, "idx"])
    return found, F.coalesce(~F.col("_blank") & ~is_blank(F.col("value_ja")), F.lit(False))


def translate_conversations(turns: DataFrame, cache: DataFrame, id: str = "id") -> DataFrame:
    """Translated conversations; one blank or untranslated turn drops the conversation."""
    found, ready = _looked_up(turns, cache, id)
    return assemble(found, id, "value_ja", keep=ready)


def translate_without_refusals(turns: DataFrame, cache: DataFrame, verdicts: DataFrame, id: str = "id") -> DataFrame:
    """Translated conversations, without those of which a translated turn is refused.

    The verdict is on the translated text, by its id; a conversation with a blank or untranslated turn is dropped before.
    Texts still to be checked do not drop one.
    """
    found, ready = _looked_up(turns, cache, id)
    outputs = found.where(~is_blank(F.col("value_ja"))).select(id, "idx", F.col("value_ja").alias("value"))
    checked = check_refusals(outputs, verdicts, [id, "idx"])
    return drop_refused(assemble(found, id, "value_ja", keep=ready), checked, id)


def translate_system_only(turns: DataFrame, cache: DataFrame, fresh: DataFrame, id: str = "id") -> DataFrame:
    """Turn rows with system texts from the cache and all others, and misses, from fresh output ``(id, idx, fresh)``."""
    found = lookup(turns, cache, [id, "idx"], when=F.col("from") == "system")
    one = fresh.groupBy(id, "idx").agg(F.min("fresh").alias("fresh"))
    joined = found.join(one, [id, "idx"], "left")
    value = F.coalesce(F.nullif("value_ja", F.lit("")), F.col("fresh"))
    return joined.select(id, "idx", "from", value.alias("value"))


def plan_requests(turns: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts still to translate, with the model that takes a prompt of that length."""
    wanted = turns.where(~is_blank(F.col("value"))).select(text_key(F.col("value")).alias("_text"), F.col("value").alias("text"))
    have = cache.select(text_key(F.col("prompt_en")).alias("_text"))
    overhead = len(fixed.TRANSLATE_REQUEST) - len("{text}")
    route = F.when(F.length("text") + overhead <= fixed.SHORT_MODEL_CHARS, "short").otherwise("long")
    return wanted.dropDuplicates(["_text"]).join(have, "_text", "left_anti").select("text", route.alias("model"))


def gate(text: Column, output: Column, leak: str = fixed.LEAK_MARKER, low: float = fixed.GATE_RATIO_LOW,
         high: float = fixed.GATE_RATIO_HIGH, min_chars: int = fixed.GATE_MIN_CHARS,
         latin: float = fixed.GATE_LATIN_SHARE, word: str = "japanese") -> Column:
    """First failing check of a translation: ``empty``, ``ratio``, ``leak``, ``untranslated``, or ``ok``."""
    ratio = utf8_bytes(output) / F.nullif(chars(text), F.lit(0))
    named = F.contains(F.lower(output), F.lit(word)) & ~F.contains(F.lower(text), F.lit(word))
    return (
        F.when(output.isNull() | (output == ""), "empty")
        .when((chars(text) >= min_chars) & ((ratio < low) | (ratio > high)), "ratio")
        .when(F.contains(output, F.lit(leak)) | named, "leak")
        .when(latin_share(output) >= latin, "untranslated")
        .otherwise("ok")
    )


def without_boilerplate(output: Column, echo: str = fixed.EMPTY_REQUEST_ECHO) -> Column:
    """Null where the output is empty or asks for the text it was given."""
    return F.when(~F.contains(output, F.lit(echo)), F.nullif(output, F.lit("")))


def pick_translator(text: Column, primary: Column, primary_name: Column, secondary: Column, secondary_name: Column) -> Column:
    """struct<value, translator>: the primary output if it passes the gate, else the secondary one, else null."""
    def choice(value: Column, name: Column) -> Column:
        return F.struct(value.alias("value"), name.alias("translator"))

    return F.coalesce(
        F.when(gate(text, primary) == "ok", choice(primary, primary_name)),
        F.when(secondary.isNotNull(), choice(secondary, secondary_name)),
    )


def check_refusals(turns: DataFrame, verdicts: DataFrame, spread: list[str]) -> DataFrame:
    """Add ``verdict`` to each turn: ``refused``, ``ok`` or ``check``. A stored verdict wins over the length rule."""
    # The length rule is settled before the join, so a caller without need of the texts does not shuffle them.
    long_text = (line_count(F.col("value")) >= fixed.REFUSAL_LINES) | (F.length("value") >= fixed.REFUSAL_CHARS)
    keyed = turns.withColumn("_uuid", uuid5(F.col("value"))).withColumn("_long", long_text)
    # of several verdicts on one text a refusal wins, and a null one says nothing
    stored = verdicts.where(F.col("refusal").isNotNull()).groupBy(F.col("id").alias("_uuid")).agg(F.max("refusal").alias("refusal"))
    joined = salted_join(keyed, stored, ["_uuid"], "left", spread)
    verdict = (
        F.when(F.col("refusal").isNotNull(), F.when(F.col("refusal"), "refused").otherwise("ok"))
        .when(F.col("_long"), "ok").otherwise("check")
    )
    return joined.withColumn("verdict", verdict).drop("_uuid", "refusal", "_long")


def refusal_summary(checked: DataFrame, id: str = "id") -> DataFrame:
    """Per conversation: dropped or not, and how many turns still need a check. Counts only, no texts gathered."""
    return checked.groupBy(id).agg(
        F.max(F.col("verdict") == "refused").alias("dropped"),
        F.count_if(F.col("verdict") == "check").alias("to_check"),
    )


def drop_refused(conversations: DataFrame, checked: DataFrame, id: str = "id") -> DataFrame:
    """Conversations without a refused turn."""
    refused = checked.where(F.col("verdict") == "refused").select(id).distinct()
    return conversations.join(refused, id, "left_anti")


def says_yes(response: Column) -> Column:
    return ~is_blank(response) & F.contains(F.lower(response), F.lit("yes"))


def token_ratio(tc: Column, tc_ja: Column) -> Column:
    """Tokens of the translation per token of the source; null when the source has none."""
    return tc_ja / F.nullif(tc, F.lit(0))


def token_ratios(corpus: DataFrame, turns: DataFrame, turns_ja: DataFrame, kind: str,
                 id: str = "id", done_by: str = "gpt-4") -> DataFrame:
    """Token counts of both sides, their ratio, the report band and whether the row goes to the redo queue."""
    both = turns.select(id, token_count(F.col("value"), kind).alias("a"), F.lit(0).cast("long").alias("b")).unionByName(
        turns_ja.select(id, F.lit(0).cast("long").alias("a"), token_count(F.col("value"), kind).alias("b"))
    )
    sums = both.groupBy(id).agg(F.sum("a").alias("tc"), F.sum("b").alias("tc_ja"))
    ratio = F.col("ratio")
    return (
        corpus.select(id, "category", "translator").join(sums, id)
        .withColumn("ratio", token_ratio(F.col("tc"), F.col("tc_ja")))
        .withColumn("band", F.when(ratio >= 3.0, "long").when(ratio <= 1.0, "short"))
        .withColumn("redo", F.coalesce(((ratio >= 3.0) | (ratio < 0.5)) & (F.col("translator") != done_by), F.lit(False)))
    )


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def cost(cache: DataFrame, kind: str) -> DataFrame:
    """Tokens and cost per translator: source tokens at the input price, output tokens at the output price."""
    sums = cache.groupBy("translator").agg(
        F.sum(token_count(F.col("prompt_en"), kind)).alias("tokens_in"),
        F.sum(token_count(F.col("prompt_ja"), kind)).alias("tokens_out"),
    )
    return sums.withColumn("cost_in", F.col("tokens_in") / 1000 * fixed.PRICE_INPUT).withColumn(
        "cost_out", F.col("tokens_out") / 1000 * fixed.PRICE_OUTPUT
    )
