"""Substring dedup by sliding sentence spans.

From every sentence on, the shortest run of several consecutive sentences that has enough words is hashed. Equal hashes are
joined over all documents; of the places of a span the first stays, and the sentences that any other covers are removed.
A sentence ends at a line end or after a word that ends in ``.``, ``!`` or ``?``. A longer one is cut after the word with the
lowest hash in each window of words without such an end, so every window has a boundary, and the same passage has the same
boundaries in any surroundings, from its second word on. A-Z count as a-z; white space does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_arrow, per_text, settle
from corpusloom.llm.hashing import mix, word_hashes
from corpusloom.operators.skew import salted_join

STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True
#: Multiplier of the polynomial over word hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Spans:
    """A span has ``sentences`` consecutive sentences or more and ``words`` words or more; any ``window`` words that follow each
    other have a boundary before one of them. So a repeated passage has its first boundary after ``window`` words at most, a
    boundary that ends a span another ``words + window - 1`` words on at most, or two windows on: 50 words hold a full span
    for windows of up to 16 words."""

    sentences: int = 2
    words: int = 15
    window: int = 11


def sentence_starts(texts: list[bytes], rule: Spans):
    """(word hashes, first word of each text, first word of each sentence, byte where each word starts)."""
    words, start, end, first = word_hashes(texts)
    if not len(words):
        return words, first, np.zeros(0, np.int64), start
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lines = np.cumsum(raw == 0x0A)
    new_line = np.r_[True, lines[start[1:]] != lines[end[:-1] - 1]]
    begins = new_line | np.r_[True, STOPS[raw[end[:-1] - 1]]]
    windows = len(words) - rule.window + 1
    if windows > 0:
        value = np.r_[np.uint64(0), mix(words[:-1] ^ FACTOR)]
        lowest, at = value[:windows].copy(), np.arange(windows)
        for j in range(1, rule.window):
            lower = value[j : j + windows] <= lowest
            lowest[lower] = value[j : j + windows][lower]
            at[lower] = np.flatnonzero(lower) + j
        seen = np.r_[0, np.cumsum(begins)]
        begins[at[seen[rule.window :] == seen[:windows]]] = True
    return words, first, np.flatnonzero(begins), start


def run_of_spans(texts: list[bytes], rule: Spans) -> dict:
    """For each text and sentence, the hash of the span that starts there, null where none fits, and its length in sentences."""
    words, first, at, _ = sentence_starts(texts, rule)
    n = len(at)
    bounds = np.searchsorted(at, first)  # sentences of each text
    if not n:
        return {"hashes": [[] for _ in texts], "lengths": [[] for _ in texts]}
    text_end = np.repeat(bounds[1:], np.diff(bounds))
    edge = np.r_[at, len(words)]
    k = np.arange(n)
    stop = np.maximum(k + rule.sentences, np.searchsorted(edge, at + rule.words))
    fits = stop <= text_end
    stop = np.where(fits, stop, k)
    # the polynomial's sum from a to b, shifted to begin at power 0 by the inverse powers
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), FACTOR)])
    inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), np.uint64(pow(int(FACTOR), -1, 1 << 64)))])
    sums = np.r_[np.uint64(0), np.cumsum(words * powers[:-1], dtype=np.uint64)]
    a, b = edge[k], edge[stop]
    h = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)).view(np.int64)
    cut = list(zip(bounds[:-1], bounds[1:], strict=True))
    length = np.where(fits, stop - k, 0)
    return {"hashes": [pa.array(h[i:j], mask=~fits[i:j]) for i, j in cut], "lengths": [length[i:j] for i, j in cut]}


def without_sentences(text: bytes, spans: list[int], rule: Spans) -> tuple[bytes, int, int]:
    """The text without the sentences of the spans that start at these sentences, how many it had, and how many went.

    A sentence goes with the white space up to the next.
    """
    _, _, at, start = sentence_starts([text], rule)
    if not spans:
        return text, len(at), 0
    edge = np.r_[start[at], len(text)]
    keep = np.ones(len(at), bool)
    length = run_of_spans([text], rule)["lengths"][0]
    for s in spans:
        keep[s : s + length[s]] = False
    return text[: edge[0]] + b"".join(text[edge[i] : edge[i + 1]] for i in np.flatnonzero(keep)), len(at), int((~keep).sum())


#: Words of 64 bits in a filter of listed hashes, at most; it has 64 bits or more for each hash up to there, and 8 for the longest list.
FILTER_WORDS = 1 << 20


def filter_holds(listed: DataFrame) -> bool:
    """Whether a list of hashes is short enough for the filter."""
    return listed.count() <= 8 * FILTER_WORDS


def mark_listed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds ``listed``: true if ``hash`` is in the list (settled, unique), and for up to an eighth of the other hashes.

    The filter is a bitmap sized from the count; its words, at most FILTER_WORDS rows of 16 bytes whatever the input, are broadcast.
    """
    words = min(FILTER_WORDS, 1 << max(10, listed.count().bit_length()))
    word = F.col("hash").bitwiseAND(F.lit(words - 1)).alias("word")
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(hash, 32) & 63 as int))")
    bitmap = listed.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    hit = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    return rows.withColumn("word", word).join(F.broadcast(bitmap), "word", "left").withColumn("listed", hit).drop("word", "bits")


def maybe_repeated(spans: DataFrame, repeated: DataFrame) -> DataFrame:
    """The spans whose hash is repeated, and a few others: those the filter leaves. So spans met once are not shuffled.

    A list too long for the filter is joined, with hot hashes salted.
    """
    if filter_holds(repeated):
        return mark_listed(spans, repeated).where("listed").drop("listed")
    return salted_join(spans, repeated, ["hash"], "inner", ["id", "body", "pos"])


def repeated_sentences(docs: DataFrame, rule: Spans) -> DataFrame:
    """(id, body, removed): the first sentences of the spans of each text that have an earlier place.

    ``docs`` has (id, body, text). First is the smallest (id, body, place); a null id comes first. Only hashes are shuffled
    to find the repeated ones; they are made twice, which costs less than to keep them all. The second time those met once
    are left out where they are made.
    """
    runs = per_text(docs, ["id", "body"], "text", {"hashes": "array<long>"}, lambda t: run_of_spans(t, rule))
    spans = runs.select("id", "body", F.posexplode("hashes").alias("pos", "hash")).where("hash is not null")
    place = F.struct("id", "body", "pos")
    times = runs.select(F.explode("hashes").alias("hash")).where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("times"))
    repeated = settle(times.where("times > 1").select("hash"))
    places = settle(maybe_repeated(spans, repeated))
    first = settle(places.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"))
    later = salted_join(places, first, ["hash"], "inner", ["id", "body", "pos"]).where(place != F.col("first"))
    return later.groupBy("id", "body").agg(F.collect_set("pos").alias("removed"))


def with_removed(source: DataFrame, found: DataFrame) -> DataFrame:
    """The texts with their sentences to remove, or null. Only texts that the filter cannot rule out meet the list by a shuffle.

    All texts do where the list is too long for the filter.
    """
    name = F.xxhash64("id", "body")
    listed = settle(found.select(name.alias("hash")).distinct())
    if not filter_holds(listed):
        same = source["id"].eqNullSafe(found["id"]) & (source["body"] == found["body"])
        return source.join(found, same, "left").select(source["id"], source["text"], "removed")
    marked = mark_listed(source.withColumn("hash", name), listed)
    some, rest = marked.where("listed"), marked.where("not listed")
    same = some["id"].eqNullSafe(found["id"]) & (some["body"] == found["body"])
    joined = some.join(found, same, "left").select(some["id"], some["text"], "removed")
    return joined.unionByName(rest.select("id", "text", F.lit(None).cast("array<int>").alias("removed")))


def drop_repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: Spans = Spans()) -> DataFrame:
    """``(doc_id, text, n_sentences, n_removed, removed_chars)``, a row per input row.

    Null text comes out empty; a text without a full span comes out as it is. Rows with the same id and text count as one
    text and come out alike; ``body``, a hash of the text, tells apart rows that share an id only.
    """
    source = docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = settle(repeated_sentences(source, rule))
    joined = with_removed(source, found).select(F.col("id").alias("doc_id"), F.col("text").cast("binary").alias("text"), "removed")
    id_type = joined.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, gone = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            clean, n, removed = zip(*(without_sentences(t, g, rule) for t, g in zip(texts, gone, strict=True)), strict=True) if texts else ((), (), ())
            chars = lambda b: len(b.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([c.decode("utf-8", "replace") for c in clean], pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([chars(t) - chars(c) if len(t) != len(c) else 0 for t, c in zip(texts, clean, strict=True)], pa.int64())],
                names=["doc_id", "text", "n_sentences", "n_removed", "removed_chars"])

    return map_arrow(joined, work, f"doc_id {id_type}, text string, n_sentences long, n_removed long, removed_chars long")
