"""Whitening of embeddings through the singular values of the centred rows.

The covariance is never formed: squaring the rows would lose half the digits.  Each task
reduces its centred rows to a triangle by blockwise QR, triangles are reduced in groups of
``FAN`` over a few shuffles, and the last one has the singular values of all rows.  Its
Householder bidiagonal form, the qd algorithm and twisted factorisations (``bidiagonal``)
give the directions.  What leaves the tasks has the size of the dimension, not of the table.

Entries are quantised to whole numbers first, and the fit takes each distinct vector once.
Sums, counts and deviations of whole numbers are exact, so centring is exact up to the one
rounding of (n x - S) / n.

Defined results: a vector that is null, of another length than most vectors, or holds null or
non-finite entries or ones that no long can hold, is dropped (entries that are missing count
as null; among equally frequent lengths the longest is taken).  Repeated rows and ids, null
ids included, each give their rows.  Directions without spread are left out, so equal
vectors, or fewer distinct vectors than components, give fewer rows, or none.  A deviation
that no long can hold is null.  Among equal eigenvalues any orthonormal directions are taken,
the same for all rows.  Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.llm import bidiagonal
from weirgauge.llm.common import query
from weirgauge.session import staged

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000  # whole numbers of the fit: floor(SCALE * entry) + SHIFT
FAN = 8  # triangles reduced together
SAFE = 1 << 62  # above, whole numbers are Python's


def usable(vector: Column, dimension: int) -> Column:
    far = float(2**62 // SCALE)
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < far)
    return F.coalesce((F.size(vector) == dimension) & F.forall(vector, entry), F.lit(False))


def whole(vector: Column) -> Column:
    """The entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT)


def _rows(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dimension)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact; as Python numbers where a long would not do."""
    most = max(int(np.abs(x.astype(float)).max(initial=0)) + 1, 1) * n + max(map(abs, sums), default=0)
    if most < SAFE:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def column_sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """(n, sum by dimension) of the vectors in ``x``, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dimension, dtype=object)
        for batch in batches:
            x = _rows(batch.column("x"), dimension)
            n += len(x)
            exact = x if np.abs(x.astype(float)).max(initial=0) * len(x) < SAFE else x.astype(object)
            total = total + exact.sum(axis=0).astype(object)
        texts = [str(n), *(str(int(t)) for t in total)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimension), pa.int32()), pa.array(texts)], ["place", "total"])

    rows = fit.mapInArrow(run, "place int, total string").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["place"]: int(r["total"]) for r in rows.collect()}  # one row for each dimension
    return found.get(-1, 0), [found.get(k, 0) for k in range(dimension)]


def _reduced(blocks: Iterator[np.ndarray], dimension: int) -> np.ndarray:
    """The triangle of all rows: each block is reduced with the triangle so far."""
    triangle = np.zeros((0, dimension))
    for block in blocks:
        triangle = np.linalg.qr(np.vstack([triangle, block]), mode="r")
    return triangle


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    dimension = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (_centred(_rows(batch.column("x"), dimension), n, sums).astype(float) / n for batch in batches)
        found = _reduced(blocks, dimension)
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["r"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, raw in zip(batch.column("group").to_pylist(), batch.column("r").to_pylist(), strict=True):
                rows = np.frombuffer(raw).reshape(-1, dimension)
                held[group] = _reduced(iter([rows]) if group not in held else iter([held[group], rows]), dimension)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([r.tobytes() for r in held.values()], pa.binary())], ["number", "r"])

    now = staged(fit.mapInArrow(run, "r binary").select(F.spark_partition_id().cast("bigint").alias("number"), "r"))
    many = (now.agg(F.max("number")).first()[0] or 0) + 1
    while many > 1:
        many = -(-many // FAN)
        grouped = now.select(F.floor(F.col("number") / FAN).cast("bigint").alias("group"), "r")
        now = grouped.repartition(many, "group").mapInArrow(combined, "number bigint, r binary")
    row = now.first()
    return np.frombuffer(row["r"]).reshape(-1, dimension) if row else np.zeros((0, dimension))


def directions(fit: DataFrame, n: int, sums: list[int], components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as rows, trace) of the covariance of the fit."""
    dimension = len(sums)
    found = triangle(fit, n, sums)
    square = np.zeros((dimension, dimension))
    square[: len(found)] = found
    values, vectors = bidiagonal.singular(square, components)
    head = np.abs(vectors).argmax(axis=1) if len(vectors) else np.zeros(0, dtype=int)
    signs = np.sign(vectors[np.arange(len(vectors)), head])
    return values / n, vectors * signs[:, None], float((square**2).sum()) / n


def identity_error(fit: DataFrame, n: int, sums: list[int], turn: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit's covariance less the identity."""
    dimension, many = len(sums), len(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many + 1, many))
        for batch in batches:
            w = (_centred(_rows(batch.column("x"), dimension), n, sums).astype(float) / n) @ turn.T
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.reshape(-1))], ["place", "total"])

    rows = fit.mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()  # components squared
    total = np.zeros((many + 1) * many)
    for place, value in rows:
        total[place] = value / n
    total = total.reshape(many + 1, many)
    covariance = total[:-1] - np.outer(total[-1], total[-1])
    return float(np.abs(covariance - np.eye(many)).max())


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component, largest eigenvalue first."""
    spark = table.sparkSession
    own = table.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{embedding}`").alias("v"))
    lengths = own.where("size(v) > 0").groupBy(F.size("v").alias("d")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], SCHEMA)
    dimension = usual["d"]
    points = own.where(usable(F.col("v"), dimension)).select("vec_id", whole(F.col("v")).alias("x"))
    fit = staged(points.select("x").distinct())
    n, sums = column_sums(fit, dimension)
    if not n:
        return spark.createDataFrame([], SCHEMA)
    values, vectors, trace = directions(fit, n, sums, components)
    many = len(values)
    if not many:
        return spark.createDataFrame([], SCHEMA)
    turn = vectors / np.sqrt(values)[:, None]
    error, explained = identity_error(fit, n, sums, turn), values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _centred(_rows(batch.column("x"), dimension), n, sums)
            w = (y.astype(float) / n) @ turn.T
            wide = np.abs(y.astype(float)).max(initial=0) ** 2 * dimension >= SAFE
            far = [(int(d) if d < 1 << 63 else None) for d in ((y.astype(object) if wide else y) ** 2).sum(axis=1)]
            rows = len(y)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), many))),
                pa.array(np.tile(np.arange(1, many + 1), rows), pa.int32()),
                pa.array(np.full(rows * many, n)),
                pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(rows), many))),
                pa.array(w.reshape(-1)),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * many, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return points.mapInArrow(run, SCHEMA)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
