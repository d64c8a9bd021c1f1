"""Writers. Each task writes its own part files; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, gzip: bool = False, partition_by: list[str] | None = None) -> None:
    """JSON lines: one record per line instead of one array, so that readers can split the files."""
    writer = df.write.option("compression", "gzip" if gzip else "none")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.option("header", True).option("sep", separator).csv(path)


def write_text(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).text(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Skip the job when the output is there already."""
    df.write.mode("ignore").parquet(path)
