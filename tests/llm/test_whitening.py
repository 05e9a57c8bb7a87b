"""Whitening against numpy's eigenvectors, with ties, few rows, bad entries and clashing names."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wharfline.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, _x long, id string, n string"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, 1, "i", "n") for k, v in enumerate(vectors)], SCHEMA).repartition(3)


def plain(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    values, components = np.linalg.eigh(np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1))
    return x, values[::-1], components[:, ::-1]


def checked(spark, vectors, apart=True):
    got = whitening.whiten(table(spark, vectors)).orderBy("vec_id", "component").collect()
    x, values, components = plain(vectors)
    k = min(8, int((values > 1e-12 * values.sum()).sum()))
    assert len(got) == len(vectors) * k
    sums, n = x.sum(axis=0), len(x)
    assert [r.deviation for r in got[::k]] == [sum(int(c) ** 2 for c in n * row - sums) for row in x] and {r.n for r in got} == {n}
    assert [r.explained for r in got[:k]] == pytest.approx((values / values.sum())[:k].tolist(), rel=1e-9)
    assert all(r.identity_error < 1e-9 for r in got)
    white = np.array([r.whitened for r in got]).reshape(len(vectors), k)
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-9
    if apart:
        want = (x - sums / n) @ components[:, :k] / np.sqrt(values[:k])
        assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-8


@pytest.mark.parametrize(("rows", "dims"), [(300, 40), (200, 3), (6, 20), (50, 1), (40, 8)])
def test_equals_eigenvectors(spark, rows, dims):
    rng = np.random.default_rng(rows)
    checked(spark, (rng.standard_normal((rows, dims)) * np.linspace(1, 3, dims)).tolist())


def test_large_gaps_stop_early(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((300, 40)) * np.array([90, 60, 40, 30, 20, 14, 10, 8] + [0.05] * 32)
    checked(spark, vectors.tolist())
    staged = whitening.stage(whitening.whole_vectors(table(spark, vectors.tolist()).select("embedding"), "embedding").select("_x"), "t")
    blocks = whitening.stage(staged.mapInArrow(whitening._packed, "block binary, n long, sums array<long>"), "t")
    assert whitening.fit(blocks).passes < 40


def test_ties_of_eigenvalues(spark):
    checked(spark, np.vstack([np.eye(10), -np.eye(10)]).tolist(), apart=False)
    checked(spark, (np.vstack([np.eye(12), -np.eye(12)]) * np.array([9, 9, 9, 5, 5, 5, 3, 3, 3, 1, 1, 1])).tolist(), apart=False)


def test_bad_rows_are_dropped(spark):
    good = np.random.default_rng(2).standard_normal((30, 5)).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [1.0, math.inf, 0.0, 0.0, 0.0], [-math.inf] * 5, [1.0, 2.0]]
    got = whitening.whiten(table(spark, good + bad))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted(r.vec_id for r in got.where("component = 1").collect()) == list(range(30))
    again = table(spark, good + bad).withColumn("vec_id", F.lit(None).cast("long"))
    assert whitening.whiten(again).where("vec_id is null").count() == 150


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [None, []])).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 4)).count() == 0
    checked(spark, [[1.0, 2.0], [1.0, 2.0], [3.0, 2.0]])


def test_huge_entries_have_no_deviation(spark):
    got = whitening.whiten(table(spark, [[1e300, 0.0], [-1e300, 1.0], [0.0, 2.0]]))
    assert got.where("deviation is null").count() > 0 and got.where("whitened is null or isnan(whitened)").count() == 0


def test_query_reads_whole_table(spark, tmp_path):
    vectors = np.random.default_rng(7).standard_normal((100, 12)).astype(np.float32)
    spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op11_whitening(spark, str(tmp_path))
    assert got.count() == 800 and got.where("identity_error > 0.0001").count() == 0
