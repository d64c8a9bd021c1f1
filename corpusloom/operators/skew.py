"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import shared_folder

HOT_ROWS = 1_000_000
TRACKED = 10_000
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def key_hash(on: list[str]) -> Column:
    """Short name of a key of any width, for choosing how it is joined; equal hashes of two keys change no result."""
    return F.xxhash64(*on)


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS, tracked: int = TRACKED) -> DataFrame:
    """``(_key, _slices)`` of the keys that hold ``hot_rows`` rows or more, with the number of tasks each should fill.

    A heavy-hitter sketch over all rows, merged from one per task. Of N rows its counts are off by less than 3.5 / (4/3 tracked)
    of N, so no key above N / 3,800 is missed; at most ``tracked`` keys are named, and N / tracked rows each bound those left.
    """
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    top = df.where(filled).agg(F.call_function("approx_top_k", key_hash(on), F.lit(tracked), F.lit(tracked)).alias("_top"))
    return (
        top.select(F.inline("_top")).where(F.col("count") >= hot_rows)
        .select(F.col("item").alias("_key"), F.greatest(F.ceil(F.col("count") / hot_rows), F.lit(2)).cast("int").alias("_slices"))
    )


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, spread: list[str],
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join a side with hot keys (left) to a side that holds each key once (right).

    A hot key fills one task per ``hot_rows`` rows that the sketch counted; its right row is repeated once per slice, which
    is no more than one row for each ``hot_rows`` left rows. Both broadcasts are the hot-key list, at most TRACKED rows of 12
    bytes. ``spread`` names the columns that identify a left row. Left rows with a null key match nothing; each
    is a key of its own.
    """
    hot = F.broadcast(hot_keys(left, on, hot_rows))
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    own = F.xxhash64(*spread)
    salted = (
        left.withColumn("_key", key_hash(on)).join(hot, "_key", "left")
        .withColumn("_salt", F.when(no_key, own).otherwise(F.coalesce(F.pmod(own, F.col("_slices").cast("long")), F.lit(0))))
        .drop("_key", "_slices")
    )
    slices = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_slices"), F.lit(1)).cast("long") - 1)
    copies = right.withColumn("_key", key_hash(on)).join(hot, "_key", "left").withColumn("_salt", F.explode(slices))
    return salted.join(copies.drop("_key", "_slices"), [*on, "_salt"], how).drop("_salt")


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, spread: list[str],
               max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a side that holds each key once and is usually small, such as one row per source or metric.

    That side is checkpointed and measured. Within ``max_rows`` and BROADCAST_BYTES it is broadcast, so the left rows
    are not shuffled at all; beyond, the salted join takes over.
    """
    shared_folder(left.sparkSession)
    right = right.checkpoint()
    width = F.octet_length(F.to_json(F.struct(*right.columns)))
    rows, size = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows <= max_rows and size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, how, spread)
