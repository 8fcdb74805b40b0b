"""Whitening of embeddings by TSQR: exact sums centre the rows, each partition is factored, and R factors merge in a tree.

The covariance is never formed: the singular values and right vectors of the last R are those of all centred rows. Four
scans of the vectors: sums, R factors, the products of whitened rows that measure the result, and the result itself.
Between them the driver holds one row of sums, one triangle and one square of the number of components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 32
#: Whole entries saturate here, so that a batch of them has a sum within 64 bits.
LARGEST = 2.0**50
FAN_IN, BLOCK_ROWS = 8, 4096
#: A component whose singular value is below this share of the largest one has no variance that doubles can tell from rounding.
LEAST = 1e-11
SAFE = 1 << 62


def whole_entries(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(64 c) + 1000000 of each entry, one row a vector; entries that a shorter vector lacks count as c = 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    if (sizes == dims).all():
        return x.reshape(len(vectors), dims)
    out = np.full((len(vectors), dims), SHIFT, dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x
    return out


@dataclass
class Centre:
    """The number of vectors and their exact sum in each dimension."""

    n: int
    sums: list[int]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as 64-bit numbers where they fit, else as Python's."""
        far = max([0, *map(abs, self.sums)]) + self.n * int(np.abs(x).max(initial=0))
        if far < SAFE:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).astype(np.float64) / self.n


def squares(distances: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None where it needs more than 63 bits."""
    far = int(np.abs(distances).max(initial=0))
    if far * far * max(1, distances.shape[1]) < SAFE:
        return (distances.astype(np.int64) ** 2).sum(axis=1).tolist()
    sums = [sum(v * v for v in row) for row in distances.astype(object).tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def centre_of(vectors: DataFrame) -> tuple[Centre, int]:
    """Exact sums of all vectors, and the number of partitions that they come in."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, []
        for batch in batches:
            if batch.num_rows:
                dims = int(pc.max(pc.list_value_length(batch.column(0))).as_py())
                part = (whole_entries(batch.column(0), dims) - SHIFT).sum(axis=0).tolist()
                total = [a + b for a, b in zip(total + [0] * (dims - len(total)), part + [0] * (len(total) - dims), strict=True)]
                n += batch.num_rows
        run = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(total))], pa.int32()), pa.array([run] * (len(total) + 1), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], names=["dim", "run", "total"]
        )

    found = vectors.select("vector").mapInArrow(sums, "dim int, run int, total decimal(38,0)")
    rows = {r["dim"]: r for r in found.groupBy("dim").agg(F.max("run").alias("run"), F.sum("total").alias("total")).collect()}  # one row a dimension
    head = rows.pop(-1, None)
    n = int(head["total"]) if head else 0
    return Centre(n, [int(rows[d]["total"]) + SHIFT * n for d in range(len(rows))]), head["run"] + 1 if head else 0


def tree_merged(parts: DataFrame, runs: int, columns: int, join: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """Matrices of ``columns`` columns, one for each run, joined in rounds of FAN_IN neighbours until one is left.

    ``parts`` has run and body (row-major doubles). Only the last one comes to the driver.
    """

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("run")
        bodies = [np.frombuffer(b, dtype=np.float64).reshape(-1, columns) for b in group["body"].to_pylist()]
        return pa.table({"run": pa.array([group["run"][0].as_py() // FAN_IN], pa.int32()), "body": pa.array([join(bodies).tobytes()], pa.binary())})

    while runs > 1:
        runs = -(-runs // FAN_IN)
        parts = parts.groupBy(F.floor(F.col("run") / FAN_IN)).applyInArrow(merge, "run int, body binary")
    last = [np.frombuffer(r["body"], dtype=np.float64).reshape(-1, columns) for r in parts.orderBy("run").collect()]  # one matrix
    return join(last) if last else None


def triangle(bodies: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(bodies), mode="r")


def total(bodies: list[np.ndarray]) -> np.ndarray:
    return np.sum(bodies, axis=0)


def per_run(vectors: DataFrame, dims: int, step: Callable[[np.ndarray | None, np.ndarray], np.ndarray]) -> DataFrame:
    """One matrix for each partition: ``step`` takes what is there so far (None at first) and a block of rows of whole entries."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far, block, held = None, [], 0
        for batch in batches:
            block.append(whole_entries(batch.column(0), dims))
            held += batch.num_rows
            if held >= BLOCK_ROWS:
                so_far, block, held = step(so_far, np.vstack(block)), [], 0
        if held:
            so_far = step(so_far, np.vstack(block))
        if so_far is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.ascontiguousarray(so_far).tobytes()], pa.binary())], names=["run", "body"])

    return vectors.select("vector").mapInArrow(reduce, "run int, body binary")


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Principal components of all vectors, and every vector whitened on them.

    Rows whose vector is null or has a null, NaN or infinite entry are dropped; every other row counts, repeated rows, rows
    of a null id and equal vectors too. Entries count as whole numbers x = floor(64 c) + 1000000, which saturate beyond
    2^50. A vector shorter than the longest one has entries c = 0 at its end. Returns for each remaining row and component
    (at most ``components``, at most the dimensions): vec_id, component from 1 by falling eigenvalue, n (vectors),
    deviation (exact sum of (n x - S)^2; null beyond 63 bits), whitened, explained (share of the total variance; 0 if there
    is none) and identity_error (largest entry of the whitened rows' covariance, measured in a scan of its own, less the
    identity). A component without variance has a null whitened, and identity_error leaves it out (null if none is left).
    Without remaining rows, or with empty vectors only, the result is empty. Other columns are not read.
    """
    bounded_batches(table.sparkSession)
    finite = F.forall("vector", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    vectors = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & finite)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    centre, runs = centre_of(vectors)
    dims = len(centre.sums)
    if not centre.n or not dims:
        return table.sparkSession.createDataFrame([], schema)

    def factor(so_far: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        return triangle([centre.rows(x)] if so_far is None else [so_far, centre.rows(x)])

    _, spread, right = np.linalg.svd(tree_merged(per_run(vectors, dims, factor), runs, dims, triangle))
    spread, k = np.append(spread, np.zeros(dims - len(spread))), min(components, dims)
    eigen = spread**2 / centre.n
    live = (spread[:k] > LEAST * spread[0]) & (spread[0] > 0)
    axes = right[:k].T / np.where(live, np.sqrt(eigen[:k]), 1.0)

    def products(so_far: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        w = centre.rows(x) @ axes
        own = np.vstack([w.T @ w, w.sum(axis=0)])
        return own if so_far is None else so_far + own

    seen = tree_merged(per_run(vectors, dims, products), runs, k, total) / centre.n
    off = np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k))[np.ix_(live, live)]
    error = float(off.max()) if live.any() else None
    explained = eigen[:k] / eigen.sum() if eigen.sum() else np.zeros(k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = whole_entries(batch.column(1), dims), batch.num_rows
            row = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, centre.n, dtype=np.int64)),
                    pa.array(squares(centre.distances(x)), pa.int64()).take(pa.array(row)),
                    pa.array((centre.rows(x) @ axes).ravel(), mask=np.tile(~live, m)),
                    pa.array(np.tile(explained, m)),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(project, schema)
