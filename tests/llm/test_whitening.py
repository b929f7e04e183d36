"""Whitened embeddings, held against a dense eigendecomposition and exact integers."""

import numpy as np
import pytest

from replyloom.llm.whitening import eigenvalues_above, intervals, leading_components, whiten

from .conftest import SMALL

SCHEMA = "vec_id long, embedding array<double>, label int, n string, component string, whitened string"


def matrices():
    rng = np.random.default_rng(0)
    for size, kind in ((64, "plain"), (64, "wide"), (3, "plain"), (1, "plain"), (64, "cluster"), (40, "equal"), (64, "low"), (120, "plain")):
        turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
        x = rng.standard_normal((4 if kind == "low" else size * 4, size))
        yield kind, {
            "plain": lambda: x.T @ x,
            "low": lambda: x.T @ x,
            "wide": lambda: turn @ np.diag(10.0 ** np.linspace(8, -4, size)) @ turn.T,
            "cluster": lambda: turn @ np.diag([*[5.0] * 3, *(1 + rng.random(size - 3) * 1e-3)]) @ turn.T,
            "equal": lambda: np.eye(size) * 3,
        }[kind]()


def test_components_equal_a_dense_decomposition():
    for kind, matrix in matrices():
        matrix = (matrix + matrix.T) / 2
        values, vectors = leading_components(matrix, 8)
        dense, basis = np.linalg.eigh(matrix)
        count = {"low": 4}.get(kind, min(8, len(matrix)))
        assert len(values) == count
        assert np.allclose(values, dense[::-1][:count], rtol=1e-11, atol=0)
        assert np.abs(vectors.T @ vectors - np.eye(count)).max() < 1e-12
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * dense[-1] * len(matrix)
        if kind in ("plain", "wide"):
            assert np.abs(np.abs((vectors * basis[:, ::-1][:, :count]).sum(axis=0)) - 1).max() < 1e-10
        found = intervals(matrix, count)
        assert sum(inside for _, _, inside in found) == eigenvalues_above(matrix, found[-1][0]) >= count


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for size in (1, 5, 47, 48, 49, 130):
        x = rng.standard_normal((size, size))
        matrix = x + x.T
        dense = np.linalg.eigvalsh(matrix)
        for shift in (-1.0, 0.0, 0.5, float(dense[0]) - 1, float(dense[-1]) + 1):
            assert eigenvalues_above(matrix, shift) == (dense > shift).sum()


def check(vectors, size):
    rows = whiten(vectors).collect()
    kept = [(r["vec_id"], r["embedding"]) for r in vectors.collect()
            if r["embedding"] and len(r["embedding"]) == size and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    x = np.floor(1024 * np.array([v for _, v in kept], dtype=float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    rank = int((values > values[0] * 1e-12).sum())
    expected = centred @ basis[:, :rank] / np.sqrt(values[:rank])
    far = [sum((n * int(a) - int(t)) ** 2 for a, t in zip(row, total)) for row in x]
    assert len(rows) == n * rank
    by_row = {}
    for r in rows:
        by_row.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(centred.T @ centred / n)) - 1) < 1e-9
    sign = np.zeros(rank)
    for (vec_id, _), d, line in zip(kept, far, expected):
        found = by_row[vec_id, d]
        assert sorted(found) == list(range(1, rank + 1))
        for c in found:
            value = found[c][0]["whitened"]
            assert abs(abs(value) - abs(line[c - 1])) < 1e-8
            if abs(value) > 1e-3:
                side = np.sign(value * line[c - 1])
                assert sign[c - 1] in (0, side)
                sign[c - 1] = side


def test_whitening(spark):
    check(spark.read.parquet(f"{SMALL}/embeddings.parquet"), 64)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(5).tolist(), 1, "own", "own", "own") for i in range(60)]
    rows += [rows[0], rows[0], (None, rows[1][1], 1, None, None, None), (70, None, None, None, None, None), (71, [], None, None, None, None),
             (72, [1.0, None, 2.0, 3.0, 4.0], 1, None, None, None), (73, [1.0, float("nan"), 2.0, 3.0, 4.0], 1, None, None, None),
             (74, [1.0, float("inf"), 2.0, 3.0, 4.0], 1, None, None, None), (75, [1.0, 2.0], 1, None, None, None)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(3), 5)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance(spark, rows):
    assert whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_equal_eigenvalues_and_lines(spark):
    square = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])]
    rows = whiten(spark.createDataFrame(square, "vec_id long, embedding array<float>")).collect()
    assert len(rows) == 8 and max(r["identity_error"] for r in rows) < 1e-12
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]
    rows = whiten(spark.createDataFrame(line, "vec_id long, embedding array<float>")).collect()
    assert len(rows) == 5 and all(abs(r["explained"] - 1) < 1e-12 for r in rows)


def test_deviation_beyond_64_bits(spark):
    rows = whiten(spark.createDataFrame([(1, [2.0**45, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] for r in rows} == {1, 2, 3} and rows[0]["deviation"] is None
