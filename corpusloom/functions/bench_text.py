"""Benchmark rows to one training text each."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(*parts: Column) -> Column:
    """Parts joined by line ends; a missing part makes the whole text null, an empty one stays."""
    out = parts[0]
    for part in parts[1:]:
        out = F.concat(out, F.lit("\n"), part)
    return out


def option_columns(columns: list[str]) -> list[str]:
    """Columns named by one capital letter, in table order."""
    return [c for c in columns if re.fullmatch("[A-Z]", c)]


def multiple_choice(question: Column, options: list[str], answer: Column) -> Column:
    """A missing option is left out; the others stay."""
    choices = F.concat_ws("\n", *[F.concat(F.lit(f"{k}. "), F.col(k)) for k in options])
    return lines(question, choices, answer)


def passage_spans(passage: Column, question: Column, spans: Column) -> Column:
    return lines(passage, question, F.array_join(spans, ", "))


def option_pick(sentence: Column, option1: Column, option2: Column, answer: Column) -> Column:
    """The sentence, then the option the answer code names."""
    return lines(sentence, F.when(answer.cast("string") == "1", option1).otherwise(option2))


def choice_arrays(question: Column, labels: Column, texts: Column, key: Column) -> Column:
    """A missing choice is left out; the others stay."""
    choices = F.zip_with(labels, texts, lambda k, t: F.concat(k, F.lit(". "), t))
    return lines(question, F.array_join(choices, "\n"), key)
