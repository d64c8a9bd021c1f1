"""Packing by minimum bin slack.

Each document's tokens are cut into pieces of the window's size; a full piece is a sequence of its own. The rest pieces are
packed by their lengths alone: the multiset of lengths is a histogram with one count per length, however many documents
there are. For each window the longest remaining piece is taken, then a subset-sum over the remaining multiset, as a bitset
with one bit per sum, gives the sum closest to what is free; going back through the bitsets gives how many of each length.
The same choice is used for as many windows as the counts allow. The pieces find their windows by their rank among pieces
of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.byte_bpe import tokenizer
from corpusloom.llm.common import numbered, per_text, settle

WINDOW = 1024
RANK_BITS = 42


def fill_window(left: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length to take so that their sum comes closest to ``room`` without passing it."""
    sums, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in left if x <= room), reverse=True):
        count, taken = min(left[length], room // length), 1
        while count > 0:
            taken = min(taken, count)
            steps.append((length, taken, sums))
            sums |= (sums << (length * taken)) & mask
            count -= taken
            taken *= 2
        if sums >> room:
            break
    at, used = sums.bit_length() - 1, {}
    for length, taken, before in reversed(steps):
        if not before >> at & 1:
            at -= length * taken
            used[length] = used.get(length, 0) + taken
    return used


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, count per length) until no piece is left. ``counts`` has at most ``window`` entries."""
    left, plan = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        used = fill_window({k: v for k, v in rest.items() if v}, window - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // v for k, v in used.items())
        for k, v in used.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
        plan.append((times, used))
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, int]:
    """Rows (key, rank it starts at, pieces per window, first sequence, offset, length, fill), sorted by key; number of sequences.

    The key is the length and the starting rank in one number.
    """
    seen, rows, sequence = {}, [], 0
    for times, used in plan:
        offset, fill = 0, sum(k * v for k, v in used.items())
        for length in sorted(used, reverse=True):
            start = seen.get(length, 0)
            rows.append(((length << RANK_BITS) + start, start, used[length], sequence, offset, length, fill))
            seen[length] = start + used[length] * times
            offset += length * used[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 7), sequence


Plan = Callable[[dict[int, int], int], list[tuple[int, dict[int, int]]]]


def pack_pieces(pieces: DataFrame, window: int = WINDOW, plan: Plan = plan_windows) -> DataFrame:
    """Adds ``sequence_id``, ``offset`` and ``sequence_tokens`` to pieces with (row, part, length), 1 <= length <= window.

    ``plan`` deals the histogram of the lengths below ``window`` to sequences.
    ``row`` comes from `numbered`; (row, part) is unique, and one row has at most one piece shorter than the window. Only the
    histogram of lengths, a number per length, and a count of full pieces per source partition pass through one place.
    """
    dealt = pieces.withColumn("_from", F.shiftright("row", 33))
    full, rest = dealt.where(F.col("length") == window), dealt.where(F.col("length") < window)
    per_part = settle(rest.groupBy("length", "_from").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, n_rest = places(plan(counts, window))
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # a row per length and choice

    @F.pandas_udf("sequence_id long, offset long, sequence_tokens long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = shared.value
        r = t[np.searchsorted(t[:, 0], (length.to_numpy() << RANK_BITS) + rank.to_numpy(), side="right") - 1] if len(t) else np.zeros((0, 7), np.int64)
        window_at, slot = np.divmod(rank.to_numpy() - r[:, 1], r[:, 2])
        return pd.DataFrame({"sequence_id": r[:, 3] + window_at, "offset": r[:, 4] + slot * r[:, 5], "sequence_tokens": r[:, 6]})

    before = Window.partitionBy("length").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "_from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranks = F.row_number().over(Window.partitionBy("length", "_from").orderBy("row")) - 1
    ranked = rest.withColumn("_at", ranks).join(offsets, ["length", "_from"])
    placed = ranked.withColumn("_p", place("length", (F.col("before") + F.col("_at")).cast("long"))).select(*pieces.columns, "_p.*")

    per_source = full.groupBy("_from").agg(F.count(F.lit(1)).alias("n"))
    # a row per source partition
    first = per_source.select("_from", F.coalesce(F.sum("n").over(Window.orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("_from").orderBy("row", "part")) - 1
    alone = full.withColumn("_at", within).join(first, "_from").select(
        *pieces.columns, (F.lit(n_rest) + F.col("before") + F.col("_at")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(window).cast("long").alias("sequence_tokens"))
    return placed.unionByName(alone)


def token_pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0,
                 keep_ids: bool = False) -> DataFrame:
    """Each document's ids and then ``end_id``, cut every ``window`` ids: ``(row, part, doc_id, start, length, ids_crc32, doc_tokens)``.

    With ``keep_ids`` also ``ids``, as bytes of little-endian unsigned 32-bit numbers. A null text is empty and has the one
    piece (end_id). Repeated rows are packed like others.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(texts: list[bytes]) -> dict:
        ids = [x + end for x in tokenizer(path)([t.decode("utf-8", "replace") for t in texts])]
        parts = [[x[i : i + 4 * window] for i in range(0, len(x), 4 * window)] for x in ids]
        out = {"doc_tokens": [len(x) // 4 for x in ids], "crcs": [[zlib.crc32(p) for p in ps] for ps in parts]}
        return out | ({"ids": ids} if keep_ids else {})

    fields = {"doc_tokens": "long", "crcs": "array<long>"} | ({"ids": "binary"} if keep_ids else {})
    tokens = numbered(per_text(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", fields, cut), "row")
    start = (F.col("part") * window).cast("long")
    rows = tokens.select("row", "doc_id", "doc_tokens", F.posexplode("crcs").alias("part", "ids_crc32"), *(["ids"] if keep_ids else []))
    cut_ids = [F.substring("ids", 4 * start + 1, F.lit(4 * window)).alias("ids")] if keep_ids else []
    return rows.select("row", "part", "doc_id", start.alias("start"), F.least(F.lit(window), F.col("doc_tokens") - start).alias("length"),
                       "ids_crc32", "doc_tokens", *cut_ids)


def pack_documents(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0,
                   keep_ids: bool = False) -> DataFrame:
    """Pieces with their sequence and offset; ``padding`` is what the sequence lacks to ``window``, none at a power of two."""
    packed = pack_pieces(token_pieces(docs, path, id, text, window, end_id, keep_ids), window).drop("row", "part")
    tokens = F.col("sequence_tokens")
    return packed.withColumn("padding", F.when(F.expr("sequence_tokens & (sequence_tokens - 1)") == 0, 0).otherwise(window - tokens).cast("long"))
