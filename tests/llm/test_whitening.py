"""Whitening against exact fractions and an eigenvalue decomposition of the covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from myospark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, whitened double, run int"


def brute(rows, components=32):
    """Per id: exact deviation; and the eigenvalues, shares and absolute projections by a plain decomposition."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims, n = max(len(x) for _, x in kept), len(kept)
    xs = [x + [1_000_000] * (dims - len(x)) for _, x in kept]
    sums = [sum(x[d] for x in xs) for d in range(dims)]
    deviation = [sum((n * x[d] - sums[d]) ** 2 for d in range(dims)) for x in xs]
    centred = np.array([[float(Fraction(n * x[d] - sums[d], n)) for d in range(dims)] for x in xs])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return n, [i for i, _ in kept], deviation, centred @ vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-300)), values[order] / values.sum()


def check(found, rows, components=32):
    n, ids, deviation, white, share = brute(rows, components)
    assert len(found) == n * len(share)
    assert set(found["n"]) == {n}
    table = found.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.allclose(np.abs(table), np.abs(white), atol=1e-6)
    assert found[found.component == 1].set_index("vec_id").loc[ids, "deviation"].tolist() == deviation
    assert np.allclose(found.groupby("component")["explained"].first(), share, rtol=1e-6)
    cov = np.cov(table.T, bias=True)
    assert found["identity_error"].nunique() == 1
    assert abs(found["identity_error"].iloc[0] - np.abs(cov - np.eye(len(share))).max()) < 1e-9
    assert found["identity_error"].iloc[0] < 1e-4


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_against_an_eigenvalue_decomposition(spark, parts):
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) * 2).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    found = whitening.whiten(spark.createDataFrame([(i, v, 0, 1, 0.5, 2) for i, v in rows], SCHEMA).repartition(parts)).toPandas()
    check(found, rows)


def test_query(spark, sf):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = queries.op11_whitening(spark, sf).toPandas()
    assert found["component"].max() == 32
    check(found, rows)


def test_rows_that_go_and_rows_that_stay(spark):
    bad = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, float("-inf")]]
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [0.5, 0.25], [-4.0]]
    rows = [(i, v, None, None, None, None) for i, v in enumerate(bad + good)] + [(None, [2.0, 2.0], 1, 1, 0.0, 1)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert sorted(found["vec_id"].dropna().unique()) == [5, 6, 7, 8, 9] and found["vec_id"].isna().sum() == 2
    check(found.fillna({"vec_id": 99}), [(5 + i, v) for i, v in enumerate(good)] + [(99, [2.0, 2.0])])


def test_components_without_variance(spark):
    rows = [(i, [float(i), float(i), 1.0], 0, 0, 0.0, 0) for i in range(6)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert found[found.component == 1]["whitened"].notna().all() and found[found.component > 1]["whitened"].isna().all()
    assert found["identity_error"].max() < 1e-9
    one = whitening.whiten(spark.createDataFrame(rows[:1], SCHEMA)).toPandas()
    assert len(one) == 3 and one["whitened"].isna().all() and one["identity_error"].isna().all() and (one["deviation"] == 0).all() and (one["explained"] == 0).all()


def test_empty_tables_and_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, 0, 0.0, 0), (2, [], 0, 0, 0.0, 0)], SCHEMA)).count() == 0


def test_large_numbers_are_exact():
    x = np.array([[10**15, -(10**15)], [5, 7]], dtype=np.int64)
    centre = whitening.Centre(10**5, [10**19, -(10**19)])
    d = centre.distances(x)
    assert d.tolist() == [[10**20 - 10**19, -(10**20) + 10**19], [5 * 10**5 - 10**19, 7 * 10**5 + 10**19]]
    assert whitening.squares(d) == [None, None]
    assert whitening.squares(np.array([[3_000_000_000, 1]], dtype=np.int64)) == [9_000_000_000_000_000_001]
