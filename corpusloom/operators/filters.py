"""Row filters and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fixed
from corpusloom.functions.text import ANY_SPACE, WORD_CHAR, is_blank, latin_share

EXCLUDED_CATEGORY = "mathjson"


def pending(corpus: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Rows still without a translation, in allowed categories (or in the given ones)."""
    allowed = F.col("category").isin(categories) if categories else F.col("category") != EXCLUDED_CATEGORY
    return corpus.where(allowed & F.col("conversation_ja").isNull())


def shortest_first(corpus: DataFrame) -> DataFrame:
    """Rows by length, with ``chars``. The length is taken before the sort, so a caller that selects narrow columns sorts those only."""
    return corpus.withColumn("chars", F.length("conversation").cast("long")).orderBy("chars", "id")


def translated(corpus: DataFrame) -> DataFrame:
    return corpus.where((F.col("category") != EXCLUDED_CATEGORY) & F.col("conversation_ja").isNotNull())


def long_rows(corpus: DataFrame, min_chars: int = 20000, done_by: str = "gpt-4") -> DataFrame:
    """Long translations by another translator; a null translator is not another one, as in SQL."""
    return corpus.where(
        (F.col("category") != EXCLUDED_CATEGORY)
        & (F.col("translator") != done_by)
        & (F.length("conversation_ja") >= min_chars)
    )


def is_plain_prompt(prompt: Column, word: str = fixed.PROMPT_WORD) -> Column:
    """True for a lower-case prompt that is no translation, foreign-script or missing-spaces task."""
    # The look-behind skips the inside of short words; it cannot hide a match, since a match starts a word.
    long_word = rf"(?<![{WORD_CHAR}])[{WORD_CHAR}]{{{fixed.LONG_WORD_CHARS},}}"
    long_words = F.regexp_count(prompt, F.lit(long_word))
    return (
        ~F.contains(prompt, F.lit(word))
        & ~F.coalesce(latin_share(prompt) <= fixed.PROMPT_MAX_LATIN_SHARE, F.lit(False))
        & (long_words < fixed.LONG_WORD_COUNT)
    )


# Fixed value: marks of code. White space of any script counts before a definition.
CODE_MARK = rf"```|\{{|(^|[{ANY_SPACE}])def | in range\(|std::|#include"


def looks_like_code(text: Column) -> Column:
    return text.rlike(CODE_MARK)


def long_pairs(pairs: DataFrame, en: str, min_chars: int = 2000) -> DataFrame:
    return pairs.where(F.length(en) > min_chars)


def without_input(df: DataFrame, column: str = "input") -> DataFrame:
    return df.where(is_blank(F.col(column)))


def with_warning(layers: DataFrame, column: str = "warning") -> DataFrame:
    return layers.where(F.col(column) != "")


def named_models(scores: DataFrame, names: list[str], model: str = "model") -> DataFrame:
    """Only the named models, with their place in the list; the list comes from the caller and is short."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(model))
    return scores.where(F.col(model).isin(names)).withColumn("place", place)
