"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name; then neighbouring names are
paired and the pairs named in turn, until each document has one name. Two documents have the same (level, name) exactly
where their texts are equal: a name stands for a sorted place among the distinct blocks or pairs, never for a hash.

The texts are shuffled once, for the distinct blocks. All else moves a 64-bit key in place of a block; keys that two
different blocks share are found, and their blocks are named and joined by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import numbered, settle

BLOCK_BYTES = 16_384
#: Runs of white space that are not one plain space already.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
NO_NAME = -(1 << 63)


def one_space(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty. Only texts with such runs pay for the pattern."""
    flat = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    runs = F.contains(flat, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        runs = runs | F.contains(flat, F.lit(c))
    return F.when(runs, F.regexp_replace(flat, SPACES, " ")).otherwise(flat)


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """An integer name per row: its place in the sorted rows of its partition, after those of earlier partitions."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _blocks(docs: DataFrame, size: int, key: Callable[[Column], Column]) -> DataFrame:
    """One row per block: (sha, pos, key, block)."""
    data = F.col("norm").cast("binary")
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("norm") / size).cast("int"), F.lit(1)) - 1)
    cut = F.transform(places, lambda i: F.substring(data, i * size + 1, F.lit(size)))
    rows = docs.select(F.sha2(data, 256).alias("sha"), F.posexplode(cut).alias("pos", "block"))
    return rows.withColumn("key", key(F.col("block")))


def name_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
                   key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: ``(row, id, sha, level, name)``; equal normalised texts, and only those, share (level, name).

    Null text counts as empty. ``row`` is a number of its own for each row, so repeated ids do no harm.
    """
    source = docs.select(F.col(id).alias("id"), one_space(F.col(text)).alias("norm"))
    data = F.col("norm").cast("binary")
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("norm") / block_bytes).cast("int"), F.lit(1)) - 1)
    keys = F.transform(places, lambda i: key(F.substring(data, i * block_bytes + 1, F.lit(block_bytes))))
    narrow = numbered(source.select("id", F.sha2(data, 256).alias("sha"), keys.alias("keys")), "row")
    names = settle(
        _named(_blocks(source, block_bytes, key).select("block").distinct(), ["block"])
        .select(key(F.col("block")).alias("key"), "name")
    )
    clashing = settle(names.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    parts = settle(narrow.select("row", "sha", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key")))
    if clashing.isEmpty():
        level = parts.join(names, "key").select("row", "n", "pos", "name")
    else:
        level = parts.join(names.join(clashing, "key", "left_anti"), "key").select("row", "n", "pos", "name")
        texts = _blocks(source, block_bytes, key).join(clashing, "key", "left_semi")
        spelled = settle(_named(texts.select("key", "block").distinct(), ["key", "block"]).withColumn("name", -1 - F.col("name")))
        found = texts.join(spelled, ["key", "block"]).select("sha", "pos", "name").distinct()
        level = level.unionByName(
            parts.join(clashing, "key", "left_semi").join(found, ["sha", "pos"]).select("row", "n", "pos", "name"))
    depth, most = 0, narrow.agg(F.max(F.size("keys"))).first()[0] or 0
    level = settle(level)
    done = [level.where("n = 1").select("row", F.lit(0).alias("level"), "name")]
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = settle(
            level.where("n > 1").groupBy("row", "n", F.shiftright("pos", 1).alias("at")).agg(
                side(0).alias("left"), F.coalesce(side(1), F.lit(NO_NAME)).alias("right"))
        )
        names = settle(_named(pairs.select("left", "right").distinct(), ["left", "right"]))
        level = settle(
            pairs.join(names, ["left", "right"])
            .select("row", F.shiftright(F.col("n") + 1, 1).alias("n"), F.col("at").alias("pos"), "name")
        )
        done.append(level.where("n = 1").select("row", F.lit(depth).alias("level"), "name"))
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return narrow.select("row", "id", "sha").join(identity, "row")


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
                     key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Which row stays of each group of equal texts: ``(doc_id, keep_id, group_size, kept, text_sha256)``, a row per input row.

    The smallest id stays, a null id last; of repeated rows with that id, one. An empty table gives no rows; texts that
    are null, empty or white space alone are texts like others (null is empty, and a run of white space one space).
    """
    named = settle(name_documents(docs, id, text, block_bytes, key))
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    groups = settle(named.groupBy("level", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")))
    return named.join(groups, ["level", "name"]).select(
        F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
