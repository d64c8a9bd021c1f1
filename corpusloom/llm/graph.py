"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import settle, settle_sized
from corpusloom.operators.skew import HOT_ROWS, salted_join

#: Link rows, twice a link, that one task works on in each round.
SHORT = 200_000


def components(links: DataFrame, hot_rows: int = HOT_ROWS, short: int = SHORT) -> DataFrame:
    """``(node, component)`` for each node of ``links`` (a, b); the component is the smallest node reachable.

    Each round, a node takes the smallest label among itself and its neighbours, then the label of that label, so reach
    doubles. Minima are taken map-side. Where there are ``hot_rows`` link rows or more, those of a node with that many are dealt
    to several tasks to meet its label, and so are the nodes of a large component; fewer fit one task whatever node they have.
    Up to ``short`` link rows are left in one partition, so that rounds over them shuffle nothing. Labels are never broadcast here,
    however small their files are; count the result before it is.
    """
    def join(many: DataFrame, one: DataFrame, on: str) -> DataFrame:
        return salted_join(many, one, [on], "inner", ["node"], hot_rows) if large else many.join(one.hint("merge"), on)

    def together(rows: DataFrame) -> DataFrame:
        return rows.coalesce(1) if few else rows

    whole = links.where("a is not null and b is not null")
    both = settle(whole.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        whole.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    size = both.count()
    large, few = size >= hot_rows, size < min(short, hot_rows)
    if few:
        both = together(settle_sized(together(both)))
    labels = together(settle_sized(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component"))))
    nothing = F.lit(None).cast(labels.schema["component"].dataType)
    while True:
        met = join(both, labels.withColumnRenamed("node", "other"), "other").select("node", "component", nothing.alias("was"))
        own = together(met.unionByName(labels.withColumn("was", F.col("component"))))
        closer = together(settle_sized(own.groupBy("node").agg(F.min("component").alias("component"), F.min("was").alias("was"))))
        onward = closer.select(F.col("node").alias("component"), F.col("component").alias("far"))
        stepped = together(settle_sized(join(closer, onward, "component").select("node", F.least("component", "far").alias("component"), "was")))
        labels = stepped.select("node", "component")
        if stepped.where("component < was").isEmpty():
            return labels
