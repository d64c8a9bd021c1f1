"""Keyed inserts and updates over whole tables.

``row_number() = 1`` is planned with a partial group limit before the shuffle, so each task sends at most one row
per key and a key with many copies does not gather in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import text_key


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def insert_new(target: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """Append batch rows whose key the target lacks; the first batch row of a key wins.

    Only the target's key column is shuffled.
    """
    fresh = first_per_key(batch, [key], [F.col(seq)]).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.drop(seq), allowMissingColumns=True)


def replace_rows(target: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """Replace or append: the last batch row of a key stands, other target rows stay."""
    last = first_per_key(batch, [key], [F.desc(seq)]).drop(seq)
    return target.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def fill_empty(target: DataFrame, batch: DataFrame, key: str, seq: str, column: str) -> DataFrame:
    """Fill an empty ``column`` from the batch, keep a filled one, insert absent keys."""
    first = first_per_key(batch, [key], [F.col(seq)]).drop(seq)
    others = [c for c in target.columns if c != key]
    t, b = target.alias("t"), first.alias("b")
    joined = t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer")
    old_side = F.col(f"t.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == column:
            return F.coalesce(F.nullif(F.col(f"t.{c}"), F.lit("")), F.col(f"b.{c}"), F.col(f"t.{c}")).alias(c)
        new = F.col(f"b.{c}") if c in first.columns else F.lit(None)
        return F.when(old_side, F.col(f"t.{c}")).otherwise(new).alias(c)

    return joined.select(F.coalesce(f"t.{key}", f"b.{key}").alias(key), *[value(c) for c in others])


def match_content(target: DataFrame, batch: DataFrame, content: str, update: str, key: str, seq: str) -> DataFrame:
    """Update the row with the same content, else insert under the batch row's own key.

    Batch rows that share a content insert once, under the first key, and the last ``update`` value stands.
    Rows without content match nothing. Contents meet by ``text_key``: the target's are not shuffled, and the batch's move
    once, as a row to be inserted needs its own.
    """
    text = text_key(F.col(content))
    known = first_per_key(
        target.where(F.col(content).isNotNull()).select(key, text.alias("_text")), ["_text"], [F.col(key)],
    ).select("_text", F.col(key).alias("_target"))
    kept = [c for c in batch.columns if c not in (update, seq)]
    merged = (
        batch.where(F.col(content).isNotNull()).withColumn("_text", text).groupBy("_text")
        .agg(F.min_by(F.struct(*kept), F.col(seq)).alias("_first"), F.max_by(F.struct(update), F.col(seq)).alias("_last"))
        .select("_text", "_first.*", "_last.*")
    )
    matched = merged.join(known, "_text", "left")
    updates = matched.where(F.col("_target").isNotNull()).select(
        F.col("_target").alias(key), F.col(update).alias("_new"), F.lit(True).alias("_hit")
    )
    inserts = matched.where(F.col("_target").isNull()).drop("_text", "_target")
    bare = batch.where(F.col(content).isNull()).drop(seq)
    updated = (
        target.join(updates, key, "left")
        .withColumn(update, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(update)))
        .drop("_new", "_hit")
    )
    return updated.unionByName(inserts, allowMissingColumns=True).unionByName(bare, allowMissingColumns=True)


def update_by_key(target: DataFrame, updates: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Write new values back by key; the last update of a key stands, missing values keep the old ones."""
    last = first_per_key(updates, [key], [F.desc(seq)]).select(
        key, *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    changed = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}
    return target.join(last, key, "left").withColumns(changed).select(*target.columns)


def merge_caches(cache: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Copy the other cache's rows that have a value; rows already present stay."""
    filled = other.where(F.col(value).isNotNull()).withColumn("_order", F.col(value))
    return insert_new(cache, filled, key, "_order")
