"""Quality rules with repetition measured by suffix arrays over words.

For a chunk of texts one suffix array is made by prefix doubling: words of different texts count as different, so no
suffix runs on into the next text, and only suffixes that are still tied are sorted again. Neighbours in the array share
their longest common prefix; an interval of such prefixes is a maximal repeated substring. The union of the spans of all
those of ``min_words`` or more is what a text repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import per_text

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    """``min_words``: shortest repeat that counts. ``max_covered``: largest share of the words inside repeats.
    ``max_repeat_share``: longest repeat as a share of the words, for repeats of ``long_words`` or more."""

    min_words: int = 6
    max_covered: float = 0.3
    max_repeat_share: float = 0.25
    long_words: int = 20


def suffix_ranks(words: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... words, and the suffix array.

    ``words`` holds numbers that differ between texts; ``ends[i]`` is where the text of word i ends. In a level, equal
    ranks mean equal words; a rank is the number of suffixes that sort before.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.r_[True, words[order][1:] != words[order][:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, reach = [rank.astype(np.int32)], 1
    while n:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        onward = tied + reach
        inside = onward < ends[tied]
        after = np.where(inside, rank[np.minimum(onward, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[tied]))
        r, a = rank[tied][by], after[by]
        first = np.r_[True, r[1:] != r[:-1]]
        new = first | np.r_[True, a[1:] != a[:-1]]
        at = np.arange(len(by))
        group = np.maximum.accumulate(np.where(first, at, 0))
        rank = rank.copy()
        rank[tied[by]] = r + np.maximum.accumulate(np.where(new, at, 0)) - group
        levels.append(rank.astype(np.int32))
        reach *= 2
    return levels, np.argsort(rank, kind="stable")


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Words that each suffix of the array shares with the one before it; 0 for the first."""
    n = len(order)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, common = order[at - 1].astype(np.int64), order[at].astype(np.int64), np.zeros(len(at), np.int64)
    for k in reversed(range(len(levels))):
        rank = np.append(levels[k], -1)
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        common += np.where((rank[x] == rank[y]) & (x < n) & (y < n) & (x != y), 1 << k, 0)
    shared[at] = common
    return shared


def repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring from there on that its text has elsewhere too."""
    levels, order = suffix_ranks(words, ends)
    shared = common_prefixes(levels, order)
    longest = np.zeros(len(words), np.int64)
    longest[order] = np.maximum(shared, np.r_[shared[1:], 0]) if len(words) else 0
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes], min_words: int) -> dict:
    """Counts per text; words are runs of bytes other than ASCII white space."""
    known: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    n, ends_at = int(counts.sum()), np.cumsum(counts)
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, n)
    text_of = np.repeat(np.arange(len(texts)), counts)
    longest = repeats(text_of * (len(known) + 1) + ids, ends_at[text_of] if n else np.zeros(0, np.int64))
    total = lambda flags: np.bincount(text_of, weights=flags, minlength=len(texts)).astype(np.int64)
    triple = np.flatnonzero(longest >= 3)
    long = np.flatnonzero(longest >= min_words)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, text_of[long], longest[long])
    dup_lines = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(SPACE)]
        dup_lines.append(len(lines) - len(set(lines)))
    return {
        "n_words": counts,
        "word_chars": [len(b"".join(ws).decode("utf-8", "replace")) for ws in split],
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": dup_lines,
        "n_repeat_words": total(covered(triple, np.full(len(triple), 3), n)),
        "n_covered_words": total(covered(long, longest[long], n)),
        "longest_repeat": top,
    }


def quality_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Counts and verdict per row: the base counts, ``n_covered_words``, ``longest_repeat``, ``base_failed``, ``kept``.

    Each row is judged alone, so repeated rows, ties and other columns do not matter. A null or empty text has no words and
    fails the base rule (fewer than 50 words).
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]
    counted = per_text(docs, [id], text, dict.fromkeys(longs, "long"), lambda texts: measure(texts, limits.min_words))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeated = (F.col("n_covered_words") > limits.max_covered * F.col("n_words")) | (
        (F.col("longest_repeat") >= limits.long_words) & (F.col("longest_repeat") > limits.max_repeat_share * F.col("n_words")))
    return counted.withColumnRenamed(id, "doc_id").withColumn("base_failed", base).withColumn("kept", ~base & ~repeated)
