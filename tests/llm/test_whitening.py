"""Whitening against a decomposition of the whole covariance in one place."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.llm import whitening as wt
from plinth.llm.queries import QUERIES


def brute(vectors, most=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    gaps = n * x - sums
    centred = gaps / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    whitened = centred @ axes[:, :most] / np.sqrt(values[:most])
    return (gaps.astype(object) ** 2).sum(axis=1), whitened, values[:most] / values.sum()


def by_row(rows):
    out = {}
    for r in rows:
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def held_against_brute(rows, ids, vectors, most=32):
    deviation, whitened, explained = brute(vectors, most)
    found = by_row(rows)
    assert set(found) == set(ids) and all(sorted(v) == list(range(1, whitened.shape[1] + 1)) for v in found.values())
    mine = np.array([[found[i][k + 1]["whitened"] for k in range(whitened.shape[1])] for i in ids])
    sign = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine - whitened * sign).max() < 1e-7
    assert [int(found[i][1]["deviation"]) for i in ids] == deviation.tolist()
    assert np.allclose([found[ids[0]][k + 1]["explained"] for k in range(whitened.shape[1])], explained, rtol=1e-9)
    errors = {r["identity_error"] for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9 and {r["n"] for r in rows} == {len(ids)}


def test_query_against_brute_force(spark, sf):
    rows = QUERIES["op12_embedding_whitening"](spark, sf)
    assert [f.dataType.simpleString() for f in rows.schema] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).collect()
    held_against_brute(rows.collect(), [r["vec_id"] for r in table], [r["e"] for r in table])


def test_vectors_that_do_not_remain(spark):
    rng = np.random.default_rng(1)
    good = {i: rng.normal(size=6).tolist() for i in range(40)}
    bad = [(100, None), (101, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (102, [math.nan] + [0.0] * 5), (103, [math.inf] + [0.0] * 5), (104, [-math.inf] * 6), (105, [])]
    rows = [(i, v, "x", 1) for i, v in [*good.items(), *bad]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n int").repartition(3)
    held_against_brute(wt.whiten_embeddings(df).collect(), list(good), list(good.values()))


def test_ids_may_be_null_and_rows_repeated(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=3).tolist() for _ in range(9)]
    df = spark.createDataFrame([(None if i < 2 else 7, v) for i, v in enumerate(vectors + vectors)], "vec_id long, embedding array<float>")
    rows = wt.whiten_embeddings(df, components=2).collect()
    assert len(rows) == 36 and sum(r["vec_id"] is None for r in rows) == 4 and {r["n"] for r in rows} == {18}


def test_no_variance_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        out = wt.whiten_embeddings(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and "whitened" in out.columns
    flat = wt.whiten_embeddings(spark.createDataFrame([(i, [float(i % 7), 2.0, 3.0 * (i % 7)]) for i in range(21)], schema)).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def test_ragged_and_huge_vectors_are_errors(spark):
    schema = "vec_id long, embedding array<double>"
    with pytest.raises(ValueError, match="entries"):
        wt.whiten_embeddings(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))
    with pytest.raises(Exception, match="too large"):
        wt.whiten_embeddings(spark.createDataFrame([(1, [1e300]), (2, [1.0])], schema))


def test_deviations_stay_exact_beyond_long():
    fit = wt.Fit(3_000_000_000, (3_000_000_000 * 1_000_000 + 17, 3_000_000_000 * 1_000_000 - 5))
    x = np.array([[1_000_400, 999_000], [1_000_000, 1_700_000]])
    column = pa.array(x.tolist())
    exact = [sum((fit.n * int(c) - s) ** 2 for c, s in zip(r, fit.sums, strict=True)) for r in x]
    assert [int(v.as_py()) for v in wt.deviations(fit.gaps(column))] == exact and max(exact) > 1 << 63


def matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T, q


@pytest.mark.parametrize("values", [np.geomspace(1, 1e-6, 300), np.linspace(5, 1, 200), np.r_[9.0, np.full(45, 4.0), np.linspace(1, 0.1, 150)], np.r_[np.full(10, 3.0), np.zeros(190)], np.ones(120)])
def test_lanczos_with_restarts_and_breakdown(values):
    a, _ = matrix(values)
    passes = []

    def apply(q):
        passes.append(q.shape[1])
        return a @ q

    found, axes = wt.leading_pairs(apply, len(values), 12, block=8, most=36)
    assert np.allclose(found, np.sort(values)[::-1][:12], atol=1e-11)
    assert np.abs(axes.T @ axes - np.eye(12)).max() < 1e-11 and np.linalg.norm(a @ axes - axes * found, axis=0).max() < 1e-11
    narrow = len(passes)
    wt.leading_pairs(apply, len(values), 12, block=8)
    assert len(passes) - narrow <= -(-len(values) // 8)  # the default basis spans all in so many


def test_a_breakdown_is_replaced():
    rng = np.random.default_rng(0)
    basis, _ = np.linalg.qr(rng.standard_normal((20, 5)))
    new, broken = wt.orthonormal(np.column_stack([basis[:, 0], rng.standard_normal(20)]), basis, 1.0, rng)
    assert broken == 1 and np.abs(np.column_stack([basis, new]).T @ np.column_stack([basis, new]) - np.eye(7)).max() < 1e-12
