"""Tables laid out by the hash of a key, so that a batch rewrites only the parts whose keys it holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "_part"


def part_of(key: str, parts: int) -> Column:
    """Part number of a key; the same for a number and its text, so a batch may hold either."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")


def _write(df: DataFrame, path: str, mode: str) -> None:
    # rebalance gathers a part's rows into few files and lets adaptive execution split a part that is too large for one task
    placed = df.hint("rebalance", PART)
    placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def write_keyed(df: DataFrame, path: str, key: str, parts: int) -> None:
    """A new table. ``parts`` stays with the table: later merges must name the same number."""
    _write(df.withColumn(PART, part_of(key, parts)), path, "errorifexists")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def merge_keyed(spark: SparkSession, path: str, batch: DataFrame, key: str, seq: str,
                merge: Callable[[DataFrame, DataFrame, str, str], DataFrame], parts: int) -> list[int]:
    """Merge a batch into the table by ``merge`` (``upsert.insert_new``, ``replace_rows`` and the like); gives the parts rewritten.

    Partition pruning reads the touched parts only, and dynamic overwrite replaces them when the job commits; all other
    files stay as they are. The driver gets the part numbers, at most ``parts``. An empty batch writes nothing. A run
    that is lost before its commit changes nothing and can be repeated; the merges give the same table when repeated.
    """
    placed = batch.withColumn(PART, part_of(key, parts))
    touched = sorted(r[0] for r in placed.select(PART).distinct().collect())
    if touched:
        stored = spark.read.parquet(path)
        old = stored.where(F.col(PART).isin(touched)).drop(PART)
        merged = merge(old, batch, key, seq).select(*old.columns)
        _write(merged.withColumn(PART, part_of(key, parts)), path, "overwrite")
    return touched
