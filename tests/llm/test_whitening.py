import math

import numpy as np
import pytest
from pyspark.sql import types as T

from headwise.llm import catalog, whitening

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    *[T.StructField(n, T.StringType()) for n in ("n", "vector", "component", "body", "base", "whitened")],
])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *["extra"] * 6) for i, v in rows], SCHEMA)


def integers(rows):
    """x of the usable rows, in order; null, empty and broken vectors go, short ones are filled with zeros."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = np.full((len(kept), width), 1_000_000, np.int64)
    for at, (_, v) in enumerate(kept):
        x[at, : len(v)] = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]
    return [i for i, _ in kept], x


def check(found, names, x, components=32):
    """Compare with a dense eigensolver; near equal eigenvalues are compared by what any basis has in common."""
    n = len(x)
    centred = (n * x.astype(object) - x.sum(axis=0).astype(object)).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((np.sqrt(np.maximum(values, 0)) > 1e-7 * math.sqrt(values[0])).sum()))
    rows = found.collect()
    assert len(rows) == n * k
    by_row = {}
    for r in rows:
        assert r.n == n and r.identity_error <= 1e-4
        by_row.setdefault(r.vec_id, {})[r.component] = r
    deviations = ((n * x.astype(object) - x.sum(axis=0).astype(object)) ** 2).sum(axis=1)
    for name, deviation in zip(names, deviations):
        assert by_row[name][1].deviation == (deviation if deviation < 2 ** 63 else None)
    w = np.array([[by_row[name][c].whitened for c in range(1, k + 1)] for name in names])
    explained = np.array([by_row[names[0]][c].explained for c in range(1, k + 1)])
    assert np.allclose(explained, values[:k] / values.sum(), rtol=1e-9)
    assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-8) and np.allclose(w.mean(axis=0), 0, atol=1e-8)
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    apart = np.abs(np.diff(np.append(values[: k + 1], 0)[: k + 1])) > 1e-6 * values[0]
    alone = apart & np.concatenate(([True], apart[:-1]))
    signs = np.sign((w * want).sum(axis=0))
    assert np.allclose((w * signs)[:, alone[:k]], want[:, alone[:k]], atol=1e-6)


@pytest.mark.parametrize("n, width, components", [(400, 7, 32), (300, 40, 32), (90, 6, 2)])
def test_matches_a_dense_solver(spark, monkeypatch, n, width, components):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    random = np.random.default_rng(n)
    data = random.standard_normal((n, width)) @ random.standard_normal((width, width)) + 5 * random.standard_normal(width)
    rows = list(enumerate(data.astype(np.float32).tolist()))
    names, x = integers(rows)
    check(whitening.whiten(vectors(spark, rows).repartition(4), components=components), names, x, components)


def test_fewer_directions_than_dimensions(spark):
    random = np.random.default_rng(3)
    data = np.repeat(random.integers(-9, 9, (200, 3)), [1, 2, 3], axis=1).astype(float)
    rows = list(enumerate(np.hstack((data, np.ones((200, 2)))).tolist()))
    names, x = integers(rows)
    check(whitening.whiten(vectors(spark, rows)), names, x)


def test_equal_deviations_in_all_directions(spark):
    rows = [(i, row) for i, row in enumerate(np.vstack((np.eye(5), -np.eye(5))).tolist())]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert len(found) == 50 and all(abs(r.explained - 0.2) < 1e-12 and r.identity_error < 1e-10 for r in found)


def test_broken_short_and_large_vectors(spark):
    random = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(random.standard_normal((60, 4)).astype(np.float32).tolist())]
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 0.0, 0.0]), (104, [float("inf")] * 4),
             (105, [1.0]), (106, [0.5, -2.0]), (107, [3e4, -1e5, 7e6, 1e3])]
    names, x = integers(rows)
    found = whitening.whiten(vectors(spark, rows))
    check(found, names, x)
    assert {r.vec_id for r in found.collect()}.isdisjoint({100, 101, 102, 103, 104})


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 0.0]), (None, [0.0, 1.0]), (4, [5.0, 5.0])]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.component) for r in found) == sorted((str(i), c) for i, _ in rows for c in (1, 2))


def test_nothing_to_fit(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        found = whitening.whiten(vectors(spark, rows))
        assert found.columns == names and found.count() == 0


def test_bidiagonal_form_holds():
    random = np.random.default_rng(5)
    x = random.standard_normal((50, 12)) * np.logspace(0, -4, 12)
    v, b = whitening.bidiagonalise(lambda w: (x.T @ (x @ w), float((x @ w) @ (x @ w))), 12, np.linalg.norm(x))
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-12)
    assert np.allclose(np.linalg.svd(b)[1], np.linalg.svd(x)[1], rtol=1e-8)
    u = np.linalg.solve(b.T, (x @ v).T).T
    assert np.allclose(u.T @ u, np.eye(12), atol=1e-6)


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(catalog.op12_whitening(spark, folder), *integers(rows))
