"""Quality by ordinal cumulative-link regression: one weight vector over hashed text, one rising threshold for each grade."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, bounded_batches, crc_mod
from .linear import Rows, adam, bounded_sample, sigmoid, text_rows

DIMS, SAMPLE, SEED, STEPS, RIDGE = 1 << 16, 6000, 7, 200, 2e-5


class OrdinalModel:
    """P(grade > k) = sigmoid(w x - cut[k]) with cut[0] < cut[1] < ..."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray, dims: int) -> None:
        self.weights, self.cuts, self.dims = weights, cuts, dims

    def above(self, rows: Rows) -> np.ndarray:
        return sigmoid(rows.dot(self.weights)[:, None] - self.cuts[None, :])


def fit_ordinal(rows: Rows, grade: np.ndarray, grades: int, dims: int, steps: int = STEPS, ridge: float = RIDGE) -> OrdinalModel:
    """Maximum likelihood by Adam; thresholds are the first one plus positive gaps, so they stay in order."""
    n, k = max(1, rows.n), grades - 1
    share = np.array([(np.sum(grade > j) + 1) / (n + 2) for j in range(k)])
    first = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(first), 1e-2))

    def cuts_of(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.append(p[dims], np.exp(p[dims + 1 :])))

    def gradient(p: np.ndarray) -> np.ndarray:
        cuts = np.concatenate([[-np.inf], cuts_of(p), [np.inf]])
        f = rows.dot(p[:dims])
        hi, lo = sigmoid(f - cuts[grade]), sigmoid(f - cuts[grade + 1])
        hi[grade == 0], lo[grade == k] = 1.0, 0.0
        prob = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        df = -(dhi - dlo) / n
        dc = np.zeros(k + 2)
        np.add.at(dc, grade, dhi / n)
        np.add.at(dc, grade + 1, -dlo / n)
        dc = dc[1:-1]
        tail = np.cumsum(dc[::-1])[::-1]
        return np.concatenate([rows.tdot(df, dims) + ridge * p[:dims], [tail[0]], tail[1:] * np.exp(p[dims + 1 :])])

    start = np.concatenate([np.zeros(dims), [first[0]], gaps])
    p = adam(gradient, start, steps, 0.05)
    return OrdinalModel(p[:dims], cuts_of(p), dims)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", grades: int = 3, sample: int = SAMPLE, dims: int = DIMS, hold_out: int = 5) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents, those of smallest id hash with crc32(id) mod ``hold_out`` <> 0.

    ``ratings`` has the ids and integer grades 0 .. grades-1; null grades and ids are not used. Without ratings every
    grade is equally likely for every text.
    """
    bounded_batches(docs.sparkSession)
    usable = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id is not null and grade is not null")
    chosen = bounded_sample(usable.where(crc_mod("id", hold_out) != 0), sample, SEED)
    small = F.broadcast(chosen.select(F.col("id").alias(P + "id"), F.col("grade").alias(P + "grade")))  # at most sample rows
    rows = docs.select(F.col(id_col).alias(P + "doc"), F.coalesce(F.col(text_col), F.lit("")).alias(P + "text")).join(small, F.col(P + "doc") == F.col(P + "id"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(text_rows(batch.column(2), dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1), pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())],
                names=["id", "grade", "idx", "val"],
            )

    got = sorted(rows.select(P + "id", P + "grade", P + "text").mapInArrow(featurize, "id string, grade int, idx binary, val binary").collect(), key=lambda r: (r["id"], r["grade"]))
    x = Rows([(np.frombuffer(r["idx"], np.int32).astype(np.int64), np.frombuffer(r["val"], np.float32).astype(float)) for r in got])
    return fit_ordinal(x, np.array([r["grade"] for r in got], dtype=int), grades, dims)


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", select_from: int = 1, least: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, expected_grade, tail_probability, grade, kept.

    ``tail_probability`` is that of a grade of at least ``select_from``; ``kept`` where it reaches ``least``; ``grade`` is
    the most likely one (the lower of ties). Null and empty texts have the model's base rates. Texts are read whole.
    """
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)  # dims floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            above = m.above(Rows(list(text_rows(batch.column(1), m.dims))))
            full = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            tail = full[:, select_from]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array(tail), pa.array((full[:, :-1] - full[:, 1:]).argmax(axis=1), pa.int32()), pa.array(tail >= least)],
                names=["doc_id", "expected_grade", "tail_probability", "grade", "kept"],
            )

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, expected_grade double, tail_probability double, grade int, kept boolean")
