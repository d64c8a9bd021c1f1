"""Writes that can be stopped and taken up again.

A run writes its parts one after the other below ``run=<stamp>``; Spark's ``_SUCCESS`` file marks a finished part. When
all are there, the run's name is put in ``manifest`` by one rename. Readers follow the manifest, so they see the whole of one run
or the run before it, never a half-written folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 8


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = _path(spark, path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def input_stamp(spark: SparkSession, *paths: str) -> str:
    """Names the state of the input files: paths, sizes and times. Reads no content; the list of files stays distributed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    row = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()
    return "-".join(map(str, row))


def run_folder(df: DataFrame, path: str, key: str, stamp: str, parts: int = PARTS) -> str:
    """Folder of a run: another input, schema or number of parts is another run."""
    named = "|".join((stamp, df.schema.json(), key, str(parts)))
    return f"{path}/run={hashlib.sha256(named.encode()).hexdigest()[:32]}"


def write_parts(df: DataFrame, path: str, key: str, stamp: str, parts: int = PARTS, only: Iterable[int] | None = None) -> list[int]:
    """Write the parts that are not finished, and give their numbers. A part is a hash share of the rows by ``key``.

    The filter on the part goes below whatever ``df`` computes per row, so that work is done once; only the scan of the
    key is repeated for each part. A half-written part has no mark and is written anew.
    """
    run = run_folder(df, path, key, stamp, parts)
    written = []
    for part in range(parts) if only is None else only:
        folder = f"{run}/part={part}"
        if not _exists(df.sparkSession, f"{folder}/_SUCCESS"):
            df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part).write.mode("overwrite").parquet(folder)
            written.append(part)
    return written


def published(spark: SparkSession, path: str) -> str | None:
    """Folder of the run that readers see."""
    if not _exists(spark, f"{path}/manifest"):
        return None
    return f"{path}/{spark.read.text(_path(spark, f'{path}/manifest').toString()).first()[0]}"


def _publish(spark: SparkSession, path: str, run: str) -> None:
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    new = _path(spark, f"{path}/manifest.{run.rsplit('=', 1)[1]}")
    out = new.getFileSystem(spark._jsc.hadoopConfiguration()).create(new, True)
    out.write(run.rsplit("/", 1)[1].encode())
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    context.rename(new, _path(spark, f"{path}/manifest"), overwrite)


def write_resumable(df: DataFrame, path: str, key: str, stamp: str, parts: int = PARTS) -> list[int]:
    """Finish a run and publish it; gives the parts that this call wrote. A run that is published already is left alone."""
    run = run_folder(df, path, key, stamp, parts)
    if published(df.sparkSession, path) == run:
        return []
    written = write_parts(df, path, key, stamp, parts)
    _publish(df.sparkSession, path, run)
    return written


def read_published(spark: SparkSession, path: str) -> DataFrame:
    run = published(spark, path)
    if run is None:
        raise FileNotFoundError(f"no finished run in {path}")
    return spark.read.parquet(run).drop("part")
