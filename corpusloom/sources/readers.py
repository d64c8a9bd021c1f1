"""Readers. Schemas are given, so no pass is spent on inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The pattern of an accuracy in a log, and the fields of a task.
ACCURACY = r'"acc":\s*(\d+\.\d+)'
TASK = "struct<type:string,prompt_en:string,prompt_ja:string,user_en:string,user_ja:string,id:int>"


def parquet_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def spread(df: DataFrame) -> DataFrame:
    """Spread a table of few files over the cores, for work that is long per byte.

    A table whose scan has tasks for more than half of the cores is left alone: at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines from many files or globs, plain or .gz; empty files give no rows."""
    return spark.read.schema(schema).json(paths)


def json_objects(spark: SparkSession, paths: str | list[str], schema: str, name_pattern: str) -> DataFrame:
    """One JSON object per file; ``model`` is taken from the file path by ``name_pattern``."""
    read = spark.read.schema(schema).option("multiLine", True).json(paths)
    return read.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), name_pattern, 1))


def json_key_values(spark: SparkSession, paths: str | list[str], name_pattern: str) -> DataFrame:
    """One JSON object per file as rows ``(model, metric, value)``, whatever its keys are; values stay text.

    An object without keys gives one row with a null metric, so that its model is not lost. A file is one record.
    """
    read = spark.read.text(paths, wholetext=True)
    model = F.regexp_extract(F.col("_metadata.file_path"), name_pattern, 1).alias("model")
    return read.select(model, F.explode_outer(F.from_json("value", "map<string,string>")).alias("metric", "value"))


def _nesting(text: Column) -> Column:
    """Brackets opened less brackets closed, outside of strings. ``text`` is free of escapes and starts outside a string."""
    bare = F.regexp_replace(text, '"[^"]*+("|$)', "")
    return F.length(F.translate(bare, "]}", "")) - F.length(F.translate(bare, "[{", ""))


def json_array(spark: SparkSession, paths: str | list[str], element: str = "string") -> DataFrame:
    """Files that hold one JSON array each: ``(file, pos, item)``. A file of any size is read by as many tasks as it has splits.

    The text source cuts a file at its commas; no escape can hold one, so each piece is scanned on its own, once as if it
    began inside a string and once outside. Per split that gives how it changes quotes and nesting from either start; a
    running sum over the splits of a file settles which start holds. A comma at nesting one and outside strings ends an
    element. Only the pieces of one element come together; windows run over one split.
    """
    read = spark.read.option("recursiveFileLookup", True).option("lineSep", ",").text(paths)
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value",
        (F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))).alias("quotes"),
        _nesting(plain).alias("outside"), _nesting(F.concat(F.lit('"'), plain)).alias("inside"),
    )
    here = W.partitionBy("file", "split").orderBy("at")
    through = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    quotes = F.sum("quotes").over(through)
    odd = (quotes - F.col("quotes")) % 2 == 1
    local = pieces.withColumns({
        "odd_end": quotes % 2 == 1,
        "from_out": F.when(odd, F.col("inside")).otherwise(F.col("outside")),
        "from_in": F.when(odd, F.col("outside")).otherwise(F.col("inside")),
    }).withColumns({"depth_out": F.sum("from_out").over(through), "depth_in": F.sum("from_in").over(through)})

    # One row per split: a file of 10 TB has some 80,000.
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = local.groupBy("file", "split").agg(F.sum("quotes").alias("q"), F.sum("from_out").alias("o"), F.sum("from_in").alias("i"))
    started = splits.withColumn("in_string", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2 == 1)
    change = F.when(F.col("in_string"), F.col("i")).otherwise(F.col("o"))
    started = started.withColumn("_change", change).select("file", "split", "in_string", F.coalesce(F.sum("_change").over(earlier), F.lit(0)).alias("depth"))
    depth = F.col("depth") + F.when(F.col("in_string"), F.col("depth_in")).otherwise(F.col("depth_out"))
    marked = local.join(started, ["file", "split"]).select(
        "file", "split", "at", "value", (depth == 0).alias("closed"),
        ((depth == 1) & (F.col("odd_end") == F.col("in_string"))).cast("long").alias("ends"),
    ).withColumn("element", F.sum("ends").over(through) - F.col("ends"))
    counted = marked.groupBy("file", "split").agg(F.sum("ends").alias("n")).select(
        "file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    whole = marked.join(counted, ["file", "split"]).groupBy("file", (F.col("before") + F.col("element")).cast("int").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("parts"), F.max("closed").alias("closed"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), ",")
    text = F.when(F.col("pos") == 0, F.regexp_replace(text, r"^\s*\[", "")).otherwise(text)
    whole = whole.withColumn("text", text).withColumn("text", F.when(F.col("closed"), F.regexp_replace("text", r"\]\s*$", "")).otherwise(F.col("text")))
    item = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), f"array<{element}>")[0]
    return whole.where(F.trim(F.regexp_replace("text", r"\s", "")) != "").select("file", "pos", item.alias("item"))


def delimited_scores(spark: SparkSession, paths: str | list[str], schema: str, separator: str = "\t") -> DataFrame:
    return spark.read.schema(schema).option("sep", separator).option("header", True).csv(paths)


def accuracies(logs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Every decimal accuracy in a log text, one row each."""
    found = F.regexp_extract_all(F.col(text), F.lit(ACCURACY), 1)
    return logs.select(*keep, F.explode(found).alias("acc")).withColumn("acc", F.col("acc").cast("double"))


def log_pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Log files cut at commas, which no accuracy holds: rows are short and a long log is read by many tasks."""
    return spark.read.option("lineSep", ",").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("log"))
