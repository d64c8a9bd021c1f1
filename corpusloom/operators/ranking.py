"""Exact "first n" selection without one task or the driver holding the selected rows.

A *cut* is a small table: per group, the order key of the last row to keep. Cuts are built from the narrow
order keys only; the wide rows are then filtered against them in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.operators.skew import sized_join
from corpusloom.session import shared_folder

HASH_BUCKETS = 1 << 14
HASH_BITS = 32


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """1-based position of each row in the total order of ``order``.

    Range sort, then a position inside each sorted partition plus the sizes of the partitions before it.
    The sorted rows are checkpointed, so that a lost executor cannot move a row to another partition.
    Pass narrow rows: all columns of ``df`` go through the sort.
    """
    shared_folder(df.sparkSession)
    placed = df.sort(*order).checkpoint().withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # One row per partition of the sort, hence bounded by the shuffle partition count.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_at") + 1)
        .drop("_id", "_part", "_at", "_offset")
    )


def cut_by_order(df: DataFrame, by: list[str], order: list[str], take: Column) -> DataFrame:
    """Cut after the first ``take`` rows of each group in ascending ``order``; ``take`` may use ``n``,
    the size of the group. Groups that are kept whole have no row."""
    ranked = global_rank(df.select(*by, *order), [*by, *order])
    groups = ranked.groupBy(*by).agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("n"))
    last = groups.withColumn("_take", take.cast("long")).where("_take < n")
    cut = F.greatest(F.col("_first") + F.col("_take") - 1, F.col("_first"))
    at = last.select(cut.alias("rank"), (F.col("_take") <= 0).alias("_none"))
    return sized_join(ranked, at, ["rank"], "inner", ["rank"]).select(*by, *[F.col(c).alias(f"_cut_{c}") for c in order], "_none")


def cut_by_hash(df: DataFrame, by: list[str], hashed: str, key: str, n: int) -> DataFrame:
    """Cut after the first ``n`` rows of each group in (hash, key) order.

    ``hashed`` is a uniform 32-bit hash, so a histogram of its leading bits finds the one bucket per group in
    which the cut lies, and only that bucket's (hash, key) pairs are ranked.
    """
    narrow = df.select(*by, hashed, key).withColumn(
        "_bucket", F.shiftright(F.col(hashed), HASH_BITS - (HASH_BUCKETS.bit_length() - 1))
    )
    up_to = W.partitionBy(*by, F.lit(0)).orderBy("_bucket")
    edge = (
        narrow.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(up_to))
        .where((F.col("_upto") > n) & (F.col("_upto") - F.col("_n") <= n))
        .withColumn("_need", F.lit(n) - F.col("_upto") + F.col("_n"))
        # With _need = 0 the cut is just before this bucket; the bucket's first row marks it.
        .select(*by, "_bucket", "_need")
    )
    inside = W.partitionBy(*by, F.lit(0)).orderBy(hashed, key)
    return (
        sized_join(narrow, edge, [*by, "_bucket"], "inner", [key])
        .withColumn("_rn", F.row_number().over(inside))
        .where(F.col("_rn") == F.greatest(F.col("_need"), F.lit(1)))
        .select(*by, F.col(hashed).alias(f"_cut_{hashed}"), F.col(key).alias(f"_cut_{key}"),
                (F.col("_need") <= 0).alias("_none"))
    )


def _not_after(order: list[str], bounds: list[Column]) -> Column:
    """(order) <= (bounds), or strictly less where the bound row itself is out. Nulls come first, as in a sort."""
    out = F.lit(True)
    for name, bound in reversed(list(zip(order, bounds))):
        before = F.coalesce(F.col(name) < bound, F.col(name).isNull() & bound.isNotNull())
        out = before | (F.col(name).eqNullSafe(bound) & out)
    return out


def _same(order: list[str], bounds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(b) for c, b in zip(order, bounds)])


def apply_cut(df: DataFrame, cut: DataFrame, by: list[str], order: list[str], spread: list[str]) -> DataFrame:
    """Keep the rows up to the cut of their group; groups without a cut stay whole.

    Without groups the cut is one row. Its values become literals, which the filter can take down to the scan.
    """
    if by:
        joined = sized_join(df, cut, by, "left", spread)
        bounds = [F.col(f"_cut_{c}") for c in order]
        none = F.col("_none")
    else:
        edge = cut.first()
        if edge is None:
            return df
        joined = df
        bounds = [F.lit(edge[f"_cut_{c}"]) for c in order]
        none = F.lit(edge["_none"])
    kept = joined.where(
        none.isNull() | (_not_after(order, bounds) & ~(none & _same(order, bounds)))
    )
    return kept.select(*df.columns)


def _null_safe(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Group columns that a plain join can match: texts that tell null apart from any value."""
    names = [f"_by_{c}" for c in by]
    for name, c in zip(names, by):
        df = df.withColumn(name, F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")))
    return df, names


def first_by_hash(df: DataFrame, n: int, hashed: Column, key: str, by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows (of each group) in hash order: a repeatable shuffle-and-take."""
    keyed, by = _null_safe(df.withColumn("_h", hashed), by or [])
    cut = cut_by_hash(keyed, by, "_h", key, n)
    return apply_cut(keyed, cut, by, ["_h", key], [key]).drop("_h", *by)


def first_in_order(df: DataFrame, take: Column, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The first ``take`` rows (of each group) in ascending, unique order; ``take`` may use ``n``."""
    keyed, by = _null_safe(df, by or [])
    return apply_cut(keyed, cut_by_order(keyed, by, order, take), by, order, order).drop(*by)
