"""Runs of periodic words, by recursive frequency splitting and a lag scan of what survives it.

A run is a stretch of words with smallest period q (words q apart are identical), of ``max(least, 2 * q)`` words or more, that
no neighbouring word extends. Every word of a run has an equal one q places before or after it, inside the run. So a word that
occurs once in a segment is in no run of it and splits it; the parts are counted anew and split again until nothing changes.
Prose dies out in a few rounds. What survives is scanned by lag: where a lag q has a run, ``q`` neighbouring places equal the
places q further on, so one whole aligned block of (q + 1) // 2 places does. Some places of each block are probed, and only
lags with a block that passes are compared place by place. A block deep inside a run known from a smaller lag
cannot show another run (two periods p and q cannot share p + q words unless one divides the other), so it is left out. This
keeps a scan near m log m steps for a segment of m words, also for one word repeated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import per_text

#: Splitting only saves work for the scan; a segment that is still losing words after so many rounds is scanned as it is.
ROUNDS = 64
#: Places of a block that are probed, as fractions of its length.
PROBES = (0.0, 1.0, 0.5, 0.25, 0.75, 0.125, 0.875)
#: Blocks that are probed at once.
BLOCKS = 1 << 20


def frequent_segments(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The stretches ``(start, end)`` of at least ``least`` words in which every word occurs twice or more.

    ``words`` are numbers from 0, equal for equal words.
    """
    done, at, n = [], np.arange(len(words)), len(words) + 1
    segment = np.zeros(len(words), np.int64)
    for _ in range(ROUNDS):
        if not len(at):
            return done
        _, which, counts = np.unique(segment * n + words[at], return_inverse=True, return_counts=True)
        stays = counts[which] > 1
        whole = np.ones(segment[-1] + 1, bool)
        whole[segment[~stays]] = False
        settled = whole[segment]
        edges = np.flatnonzero(np.diff(np.r_[-1, segment[settled], -1]))
        places = at[settled]
        done += [(int(places[a]), int(places[b - 1]) + 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        rest = stays & ~settled
        at, was = at[rest], segment[rest]
        segment = np.cumsum(np.r_[0, (np.diff(at) != 1) | (np.diff(was) != 0)]) if len(at) else at
        large = (np.bincount(segment) >= least)[segment] if len(at) else segment.astype(bool)
        at, segment = at[large], segment[large]
        segment = np.cumsum(np.r_[0, np.diff(segment) != 0]) if len(at) else at
    edges = np.r_[0, np.flatnonzero(np.diff(segment)) + 1, len(segment)]
    return done + [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _likely_lags(x: np.ndarray, low: int, high: int, runs: dict[tuple[int, int], int]) -> np.ndarray:
    """Lags of ``low <= lag < high`` with an aligned block whose probed places all equal those one lag further on."""
    known = sorted((s, e) for (s, e), q in runs.items() if q <= (low + 1) // 2)
    starts = np.array([s for s, _ in known], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in known], np.int64)) if known else starts
    found = []
    lags = np.arange(low, high)
    blocks = (len(x) - lags) // ((lags + 1) // 2)
    cuts = np.searchsorted(np.cumsum(blocks), np.arange(BLOCKS, blocks.sum() + BLOCKS, BLOCKS), side="left") + 1
    for a, b in zip(np.r_[0, cuts[:-1]], cuts, strict=True):
        lag = np.repeat(lags[a:b], blocks[a:b])
        half = (lag + 1) // 2
        first = np.cumsum(blocks[a:b]) - blocks[a:b]
        start = (np.arange(len(lag)) - np.repeat(first, blocks[a:b])) * half
        if known:
            run = np.searchsorted(starts, start, side="right") - 1
            new = (run < 0) | (reach[run] < start + half + lag)
            lag, half, start = lag[new], half[new], start[new]
        for probe in PROBES:
            at = start + ((half - 1) * probe).astype(np.int64)
            same = x[at] == x[at + lag]
            lag, half, start = lag[same], half[same], start[same]
        found.append(np.unique(lag))
    return np.concatenate(found) if found else lags[:0]


def scan_lags(x: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """The runs of a segment: ``(start, end)`` to smallest period."""
    runs, low = {}, 1
    while low <= len(x) // 2:
        for lag in _likely_lags(x, low, min(2 * low, len(x) // 2 + 1), runs):
            same = np.r_[False, x[:-lag] == x[lag:], False]
            edges = np.flatnonzero(same[1:] != same[:-1])
            start, end = edges[::2], edges[1::2]
            long = end - start >= max(lag, least - lag)
            for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True):
                runs.setdefault((s, e + int(lag)), int(lag))
        low *= 2
    return runs


def word_runs(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out = []
    for a, b in frequent_segments(x, least):
        out += [(a + s, e - s, q) for (s, e), q in scan_lags(x[a:b], least).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    inside = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        inside[start + period] += 1
        inside[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0))


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``, a row per input row; repeated rows and null ids are rows like others.

    ``runs`` is an array of (start, length, period) by start, then period, in words from 0; ``collapsed`` is the text with one
    period left of each run and its words joined by one space. Words are what ASCII white space leaves. A null or
    empty text has no words, no runs and an empty collapsed text. An empty table gives no rows; other columns stay behind.
    """
    def work(texts: list[bytes]) -> dict:
        out = {"n_words": [], "starts": [], "lengths": [], "periods": [], "collapsed": []}
        for words in (t.split() for t in texts):
            runs = word_runs(words, least)
            out["n_words"].append(len(words))
            for name, place in (("starts", 0), ("lengths", 1), ("periods", 2)):
                out[name].append([r[place] for r in runs])
            out["collapsed"].append(collapse(words, runs))
        return out

    fields = {"n_words": "long", "starts": "array<long>", "lengths": "array<long>", "periods": "array<long>", "collapsed": "binary"}
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    runs = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    return per_text(source, ["doc_id"], "text", fields, work).select(
        "doc_id", "n_words", runs.alias("runs"), F.col("collapsed").cast("string").alias("collapsed"))


def run_digests(found: DataFrame) -> DataFrame:
    """One row per row of `periodic_runs`: count and digest of its runs, its longest run, and the digest of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("low"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") == 0, "").otherwise(F.concat(lines, F.lit("\n")))
    return found.withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.back")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.low")).alias("period"), F.expr("1000 * _best.length div -_best.low").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def tiled(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with planted runs: in every tenth document, by the checksum of its id, the words from one place on repeat.

    With h the checksum, g = h div 10 and n words, word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    A document with a null id is left as it is.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.crc32(F.col(id).cast("string").cast("binary")).alias("_h"))
    planted = planted.withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    planted = planted.withColumn("_n", F.size("_words")).withColumn("_g", F.expr("_h div 10")).withColumn("_a", F.expr("if(_n > 0, _g % _n, 0)"))
    planted = planted.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    repeated = F.expr("array_join(transform(_words, (w, i) -> if(i < _a, w, _words[cast(_a + (i - _a) % _p as int)])), ' ')")
    return planted.select("doc_id", F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), repeated).otherwise(F.col("text")).alias("text"))
