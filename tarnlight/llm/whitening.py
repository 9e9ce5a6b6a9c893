"""Whitening of embeddings: a tiled covariance of the distinct vectors, its eigenvectors, and a projection of every row.

Entries become whole numbers, ``floor(scale * c)``.  The fit list holds each distinct vector once; its number n and
its sums S of each dimension are exact.  The list is cut into row blocks, a row block into column blocks of ``tile``
dimensions.  Each column block is sent to the tiles (pairs of column blocks) that it takes part in;
where the two blocks of a tile and row block meet, their centred values are multiplied, and the products are summed for each
tile.  The assembled matrix, whose size is that of the dimensions squared, is decomposed on the driver.  A second
pass over the fit list takes the covariance of what the projection gives.

Defined results: rows whose vector is null, or holds a null or an entry that is not finite, are dropped; so are
rows whose vector hasn't the length that most rows have (of equally frequent lengths, the
largest).  Rows that repeat an id or a vector each get their rows; ids may be null.  A component whose
eigenvalue is not above ``EPSILON`` of the trace (a constant or dependent dimension, or a single distinct vector)
has no rows, so an empty table, or one distinct vector, gives none.  Of two opposite eigenvectors the one whose largest
entry is positive is taken.  ``deviation`` is exact, and null beyond 64 bits.  Only ``vec_id`` and ``embedding`` are read.

Scale: one exchange of the distinct vectors (equal ones are reduced on the map side first, so a hot vector is a row a
task), one of the column blocks, each (tiles a side + 1) times, and one of the partial tiles, which are
summed within a task before.  Row blocks are bounded in rows, so no group grows with the table; what the
driver and every task hold is S, the matrix and the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlight.llm.shared import StepTables

SCALE, COMPONENTS, TILE, ROW_BLOCK = 256, 4, 32, 4096
EPSILON = 1e-12
LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, the sums of their dimensions, unit eigenvectors (a row each), eigenvalues, and the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """A row of whitened values for each row of ``x``."""
        return (x - (self.sums / self.n).astype(np.float64)) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact squared length of n * x - S for each row."""
        reach = self.n * _reach(x) + _reach(self.sums)
        exact = np.int64 if reach * reach * max(1, x.shape[1]) <= LONG.max else object
        off = x.astype(exact) * self.n - self.sums.astype(exact)
        return [int(v) if v <= LONG.max else None for v in (off * off).sum(axis=1)]


def entries(vector: str = "embedding", scale: int = SCALE) -> Column:
    """The whole-number vector; null where there is no vector, or one with a null or an entry that is not finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(v, lambda c: F.floor(c * scale)))


def _reach(x: np.ndarray) -> int:
    """The largest absolute entry."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long rows as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _totals(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and exact sums of each dimension, added up within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                wide = x.sum(axis=0) if _reach(x) * len(x) <= LONG.max else x.astype(object).sum(axis=0)
                n, sums = n + len(x), [int(a) + int(b) for a, b in zip(sums or [0] * x.shape[1], wide)]
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[str(s) for s in sums]]}, schema=pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string()))]))

    parts = fit.mapInArrow(run, "n bigint, sums array<string>")
    rows = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(rows, key=lambda r: r["at"])]
    return (rows[0]["n"] if rows else 0), np.array(sums, dtype=np.int64 if all(abs(s) <= LONG.max for s in sums) else object)


def _column_blocks(fit: DataFrame, mean: np.ndarray, tile: int, row_block: int) -> DataFrame:
    """(block, i, j, left, cells): each column block of each row block, once for every tile (i, j) that it is a side of.

    ``block`` names a row block by its partition and place in it; ``fit`` is a written table, so a task that runs again makes the same blocks.
    """
    sides = range(-(-len(mean) // tile))
    schema = pa.schema([("block", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("left", pa.bool_()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, row_block):
                x = _matrix(batch.column(0).slice(start, row_block)).astype(np.float64) - mean
                cells = [np.ascontiguousarray(x[:, s * tile : (s + 1) * tile]).tobytes() for s in sides]
                for i in sides:
                    tiles = [(place, min(i, j), max(i, j), i <= j, cells[i]) for j in sides] + [(place, i, i, False, cells[i])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*tiles), schema)], schema=schema)
                place += 1

    return fit.mapInArrow(run, "block bigint, i int, j int, left boolean, cells binary")


_PART = "i int, j int, cells binary"


def _products(blocks: DataFrame, dims: int, tile: int) -> DataFrame:
    """(i, j, cells): the product of the two sides of each tile and row block."""
    width = {s: min(tile, dims - s * tile) for s in range(-(-dims // tile))}

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        sides = {left: np.frombuffer(cells) for left, cells in zip(rows.column("left").to_pylist(), rows.column("cells").to_pylist())}
        product = sides[True].reshape(-1, width[i]).T @ sides[False].reshape(-1, width[j])
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "cells": pa.array([product.tobytes()], pa.binary())})

    return blocks.groupBy("block", "i", "j").applyInArrow(run, _PART)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles added up by (i, j)."""
    tiles: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, j, cells in zip(*[c.to_pylist() for c in batch.columns]):
            tiles[i, j] = tiles.get((i, j), 0) + np.frombuffer(cells)
    if tiles:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tiles], pa.int32()), pa.array([k[1] for k in tiles], pa.int32()), pa.array([v.tobytes() for v in tiles.values()], pa.binary())], names=["i", "j", "cells"])


def covariance(fit: DataFrame, n: int, sums: np.ndarray, tile: int = TILE, row_block: int = ROW_BLOCK) -> np.ndarray:
    """The covariance (divisor n) of the vectors ``x`` of ``fit``, centred before they are multiplied."""
    dims = len(sums)
    mean = (sums / n).astype(np.float64)
    partial = _products(_column_blocks(fit, mean, tile, row_block), dims, tile).mapInArrow(_summed, _PART)
    whole = partial.repartition("i", "j").mapInArrow(_summed, _PART)
    out = np.zeros((dims, dims))
    for r in whole.collect():  # the assembled matrix
        rows, cols = slice(r["i"] * tile, (r["i"] + 1) * tile), slice(r["j"] * tile, (r["j"] + 1) * tile)
        block = np.frombuffer(bytes(r["cells"])).reshape(out[rows, cols].shape) / n
        out[rows, cols] = block
        out[cols, rows] = block.T
    return out


def decompose(matrix: np.ndarray, n: int, sums: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """The components of largest variance."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    trace = float(np.trace(matrix))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > EPSILON * trace and values[k] > 0]
    chosen = np.array([vectors[:, k] * (1 if vectors[np.argmax(np.abs(vectors[:, k])), k] > 0 else -1) for k in order]).reshape(len(order), len(sums))
    return Whitening(n, sums, chosen, values[order], trace)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.project(_matrix(batch.column(0)))
                first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_pydict({"sums": [[*first, *second.ravel()]]}, schema=pa.schema([("sums", pa.list_(pa.float64()))]))

    rows = fit.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()
    sums = np.array([r["s"] for r in sorted(rows, key=lambda r: r["at"])])
    mean = sums[:k] / model.n
    found = sums[k:].reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(found - np.eye(k)).max(initial=0.0))


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows with a sound vector of any length."""
    return rows.select(F.col(vec_id).alias("vec_id"), entries(vector, scale).alias("x")).filter(F.col("x").isNotNull())


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, tile: int = TILE, row_block: int = ROW_BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each sound row and component."""
    tables = StepTables(rows, "whitening")
    own = usable(rows, vec_id, vector, scale)
    schema = T.StructType([own.schema["vec_id"], *T._parse_datatype_string("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])
    longest = own.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if longest is None or longest["size"] == 0:
        return rows.sparkSession.createDataFrame([], schema)
    own = own.filter(F.size("x") == longest["size"])
    fit = tables.keep(own.select("x").distinct())
    n, sums = _totals(fit)
    model = decompose(covariance(fit, n, sums, tile, row_block), n, sums, components)
    if not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, model)
    k = len(model.values)
    share = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = _matrix(batch.column(1)), batch.num_rows
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()), model.project(x).ravel(), np.tile(share, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    return own.mapInArrow(run, schema)
