"""Helpers that several operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import fresh_folder, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table known to be short that one task takes.
TASK_ROWS = 50_000


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write rows to the shared checkpoint folder and go on from there.

    It cuts the lineage, so a lost executor costs a read and not the work before, and it fixes values such as
    ``monotonically_increasing_id``. ``rows`` bounds what the last stage works on: so few rows are written, and later read, by few tasks.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(1 + rows // TASK_ROWS)).checkpoint()


def settle_sized(df: DataFrame) -> DataFrame:
    """``settle`` as Parquet, for a table that a loop joins with itself round after round.

    A checkpoint keeps the size that Spark estimated for its plan, and a join's estimate is the product of its sides'. In such a loop
    the digits of that number multiply each round, until it fills the driver's memory. Files are sized anew, but as compressed: joins
    with such a table should name their kind, lest a large one is broadcast.
    """
    path = fresh_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str) -> DataFrame:
    """Rows with a number of their own each, fixed by a checkpoint. Numbers are unique, not consecutive."""
    return settle(df.withColumn(column, F.monotonically_increasing_id()))


#: Bytes of text that a task works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bytes that go to a Python worker at once; the session's own setting counts rows, however long, up to 64 MB or more.
BATCH_BYTES = 4 << 20
ARROW = {
    "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of BATCH_BYTES. Sets the session's bytes per Arrow batch; a worker gives free memory back."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return df.mapInArrow(bounded, schema)


def give_back() -> None:
    """Return freed memory to the system; the worker lives on with whatever it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def per_text(docs: DataFrame, keys: list[str], text: str, fields: dict[str, str],
             compute: Callable[[list[bytes]], dict], chunk: int = CHUNK_BYTES) -> DataFrame:
    """The key columns and, for each text, the ``fields`` (name to type) that ``compute`` gives for lists of texts.

    Texts reach it as UTF-8, null as empty, in chunks of ``chunk`` bytes, so a task holds one chunk (or one long text).
    Columns of ``docs`` other than the keys and the text stay behind.
    """
    source = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    spark_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"`{n}` {t}" for n, t in fields.items()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys))
            sizes = pc.binary_length(texts).to_pylist()
            schema = pa.schema([*list(batch.schema)[: len(keys)], *(pa.field(f, ARROW[t]) for f, t in fields.items())])
            start, size = 0, 0
            for i, n in enumerate(sizes):
                size += n
                if size >= chunk or i + 1 == len(sizes):
                    made = compute(texts.slice(start, i + 1 - start).to_pylist())
                    own = [batch.column(k).slice(start, i + 1 - start) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(made[f], ARROW[t]) for f, t in fields.items())], schema=schema)
                    start, size = i + 1, 0

    return map_arrow(source, work, spark_schema)


#: Rows of ids that may be broadcast: 16 bytes each, so 8 MB. Longer lists are joined by a shuffle.
BROADCAST_IDS = 500_000


def small_side(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A settled list of ids, marked for broadcast if it is measured to be short."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def text_hash(text: str) -> Column:
    """A number that tells texts of one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, ids: DataFrame, id: str = "doc_id") -> DataFrame:
    """Rows whose id is not listed; a null id is never listed. Texts are shuffled only where the list is long."""
    listed = small_side(settle(ids.where(F.col(id).isNotNull()).select(id).distinct()))
    return docs.join(listed, id, "left_anti").select(*docs.columns)


def without_rows(docs: DataFrame, rows: DataFrame, own: Column, id: str = "doc_id") -> DataFrame:
    """Rows of which (id, ``own`` value) is not listed in ``rows`` (id, value); a null id is one like others."""
    lead = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any column's name
    listed = rows.select(F.col(rows.columns[0]).alias(lead + "id"), F.col(rows.columns[1]).alias(lead + "value")).distinct()
    marked = docs.withColumn(lead + "own", own)
    same = marked[id].eqNullSafe(F.col(lead + "id")) & (marked[lead + "own"] == F.col(lead + "value"))
    return marked.join(small_side(settle(listed)), same, "left_anti").select(*docs.columns)
