"""Whitening of embeddings by a bidiagonal qd solver.

Rows are centred on exact whole sums. Each task reduces its rows to one upper triangle by blockwise QR; triangles are stacked
and reduced again, a bounded number at a time, until one is left. It has as many rows as there are dimensions, and
`bidiagonal` finds its singular values and right singular vectors on the driver. A further pass projects the rows, and
another checks the covariance of what came out. No row leaves its task in any of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bidiagonal import right_vectors
from corpusloom.llm.common import map_arrow, settle

#: x = floor(SCALE * c) + SHIFT for an entry c.
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on are counted as not finite, so that sums of x stay whole numbers of 64 bits.
LARGEST = 2.0**32
#: Rows that are reduced at once, and states that one task puts together.
BLOCK, FAN = 4096, 16
#: An eigenvalue below this share of the largest is rounding: the direction has no variance to whiten.
NO_VARIANCE = 1e-13


def whole_vectors(docs: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """(id, x): the usable rows with their entries as whole numbers, and how many entries each has.

    Usable are rows whose vector is not null or empty, holds no null, infinite or NaN entry, and has the commonest number of entries
    of such rows (ties: the larger). Without any the number is 0.
    """
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = docs.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(fine)
    sizes = rows.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    x = F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")).cast("long") + SHIFT)
    return rows.where(F.size(vector) == size).select(F.col(id).alias("id"), x.alias("x")), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def fold(states: DataFrame, combine: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One state of all rows (part, state), FAN at a time; ``state`` is an array of doubles, ``part`` a number of its own."""
    def put(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "state": [combine(list(rows.sort_values("part")["state"]))]})

    states = settle(states)
    while states.count() > 1:
        states = settle(states.groupBy(F.expr(f"part div {FAN}").alias("part")).applyInPandas(put, "part long, state array<double>"))
    left = states.first()
    return np.array(left["state"]) if left else None


def per_task(rows: DataFrame, size: int, state: Callable[[Iterator[np.ndarray]], np.ndarray | None]) -> DataFrame:
    """(part, state): a state of each task's rows, which come as blocks of whole numbers."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (x[i : i + BLOCK] for x in (_matrix(b.column(0), size) for b in batches) for i in range(0, len(x), BLOCK))
        made = state(blocks)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.list_(pa.float64()))], names=["state"])

    return map_arrow(rows.select("x"), work, "state array<double>").select(F.spark_partition_id().cast("long").alias("part"), "state")


def totals(rows: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of rows and the exact sum of each entry."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, np.int64)
        for batch in batches:
            n, sums = n + batch.num_rows, sums + _matrix(batch.column(0), size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums], pa.list_(pa.int64()))], names=["n", "sums"])

    parts = map_arrow(rows.select("x"), work, "n long, sums array<long>")
    summed = parts.select("n", F.posexplode("sums").alias("at", "sum")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).collect()
    sums = np.zeros(size, np.int64)
    for r in summed:  # a row per dimension
        sums[r["at"]] = r["sum"]
    return (summed[0]["n"] if summed else 0), sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once: the numerator is a whole number wherever that fits 64 bits."""
    if n * float(np.abs(x).max(initial=0)) < 2.0**62:
        return (n * x - sums) / float(n)
    return (x - sums // n) - (sums % n) / float(n)


def squared_distance(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum of (n * x - sums)^2 for each row; null beyond 64 bits."""
    if n * float(np.abs(x).max(initial=0)) < 2.0**62:
        far = n * x - sums
        if float(np.abs(far).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (far * far).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def upper_triangle(rows: DataFrame, size: int, n: int, sums: np.ndarray) -> np.ndarray | None:
    """R with R'R the centred rows' products."""
    def reduce(blocks: list[np.ndarray]) -> np.ndarray:
        stacked = np.vstack([b.reshape(-1, size) for b in blocks])
        r = np.linalg.qr(stacked, mode="r") if len(stacked) > 1 else stacked
        return np.vstack([r, np.zeros((max(0, size - len(r)), size))])[:size].reshape(-1)

    def state(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        r = None
        for x in blocks:
            r = reduce([centred(x, n, sums)] if r is None else [r, centred(x, n, sums)])
        return r

    return fold(per_task(rows, size, state), reduce)


def identity_error(rows: DataFrame, size: int, n: int, sums: np.ndarray, project: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = project.shape[1]

    def merge(states: list[np.ndarray]) -> np.ndarray:
        counts = np.array([s[0] for s in states])
        means = np.array([s[1 : k + 1] for s in states])
        mean = counts @ means / counts.sum()
        off = means - mean
        products = sum(s[k + 1 :].reshape(k, k) for s in states) + (off * counts[:, None]).T @ off
        return np.r_[counts.sum(), mean, products.reshape(-1)]

    def state(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        made = None
        for x in blocks:
            w = centred(x, n, sums) @ project
            off = w - w.mean(axis=0)
            own = np.r_[float(len(w)), w.mean(axis=0), (off.T @ off).reshape(-1)]
            made = own if made is None else merge([made, own])
        return made

    found = fold(per_task(rows, size, state), merge)
    return None if found is None else float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


WHITENED = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(docs: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row per usable row and component.

    Usable rows: see `whole_vectors`; all of them are fitted. Components are numbered from 1 by falling variance, ``components`` at
    most, and only those with variance: equal vectors alone give no rows, as does an empty table. Repeated rows and rows
    with a null id are rows like others. ``deviation`` is null where it is beyond 64 bits. Other columns stay behind.
    """
    spark = docs.sparkSession
    rows, size = whole_vectors(docs, id, vector)
    id_type = rows.schema["id"].dataType.simpleString()
    empty = spark.createDataFrame([], WHITENED.format(id=id_type))
    n, sums = totals(rows, size) if size else (0, np.zeros(0, np.int64))
    triangle = upper_triangle(rows, size, n, sums) if n else None
    if triangle is None:
        return empty
    squares, vectors = right_vectors(triangle.reshape(size, size))
    values = squares / n
    k = min(components, int((values > NO_VARIANCE * values[0]).sum()) if values[0] > 0 else 0)
    if not k:
        return empty
    project = vectors[:, :k] / np.sqrt(values[:k])
    shared = spark.sparkContext.broadcast((n, sums, project))  # size * (k + 1) numbers
    error, explained = identity_error(rows, size, n, sums, project), (values[:k] / values.sum()).tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, project = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), size)
            white = pa.array((centred(x, n, sums) @ project).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(white) + 1, k), pa.int32()), white)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squared_distance(x, n, sums), pa.int64()), lists], names=["id", "deviation", "white"])

    projected = map_arrow(rows, work, f"id {id_type}, deviation long, white array<double>")
    share = F.element_at(F.array(*(F.lit(e) for e in explained)), F.col("component"))
    return projected.select("id", "deviation", F.posexplode("white").alias("at", "whitened")).withColumn("component", F.col("at") + 1).select(
        F.col("id").alias("vec_id"), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"))
