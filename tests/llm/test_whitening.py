import math
from fractions import Fraction

import numpy as np
import pytest

from tablework.llm import queries, whitening


def plain(rows):
    """The whole numbers of the usable rows."""
    out = []
    for name, vector in rows:
        if vector and all(c is not None and math.isfinite(c) for c in vector):
            out.append((name, [math.floor(64 * float(c)) + 1_000_000 for c in vector]))
    return out


def check(found, rows, components=16):
    kept = plain(rows)
    fit = sorted({tuple(x) for _, x in kept})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(dims)]
    centred = np.array([[float(Fraction(n * x[i] - sums[i], n)) for i in range(dims)] for x in fit])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    most = min(components, int((values > dims * 2.3e-16 * values[0]).sum()))
    assert len(found) == len(kept) * most
    by_row = {}
    for r in found:
        by_row.setdefault(r["vec_id"], []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-8
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
    sign = {}
    for name, x in kept:
        moved = [n * x[i] - sums[i] for i in range(dims)]
        want = np.array([m / n for m in moved]) @ vectors / np.sqrt(np.abs(values) + 1e-300)
        mine = [r for r in by_row[name] if r["deviation"] == sum(m * m for m in moved)]
        assert sorted({r["component"] for r in mine}) == list(range(1, most + 1))
        for r in mine:
            k = r["component"]
            if abs(want[k - 1]) > 1e-6:
                sign.setdefault(k, np.sign(want[k - 1]) * np.sign(r["whitened"]))
                assert r["whitened"] * sign[k] == pytest.approx(want[k - 1], rel=1e-6, abs=1e-8)


def test_whole_table(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(queries.QUERIES["op12_whitening"](spark, folder).collect(), rows)


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(c) for c in draw.normal(size=5) * (5, 3, 2, 1, 0.1)]) for i in range(60)]
    rows += rows[:20] + [(90, rows[0][1]), (None, rows[1][1])]
    odd = [(91, None), (92, []), (93, [None] * 5), (94, [1.0, float("nan"), 0.0, 0.0, 0.0])]
    odd += [(95, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (96, [1.0, 2.0])]
    both = [(i, v, "x", 1) for i, v in rows + odd]
    df = spark.createDataFrame(both, "vec_id long, embedding array<double>, x string, component int")
    check(whitening.whitened(df).collect(), rows)
    named = df.withColumnsRenamed({"vec_id": "n", "embedding": "i"})
    assert whitening.whitened(named, 2, "n", "i").count() == 2 * len(rows)


def test_no_variance_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = whitening.whitened(spark.createDataFrame(rows, schema))
        assert found.columns[:3] == ["vec_id", "component", "n"] and found.collect() == []


def test_flat_directions_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(50)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["component"] for r in found} == {1}
    check(found, rows)


def test_values_beyond_64_bit_products(spark):
    rows = [(i, [1e15 * (i % 7), -3e14 * (i % 5), float(i)]) for i in range(40)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    kept = plain(rows)
    fit = sorted({tuple(x) for _, x in kept})
    sums = [sum(x[i] for x in fit) for i in range(3)]
    for r in found:
        exact = sum((len(fit) * c - s) ** 2 for c, s in zip(kept[r["vec_id"]][1], sums))
        assert r["deviation"] == (exact if exact < 1 << 63 else None)
        assert r["identity_error"] < 1e-4


@pytest.mark.parametrize("gap", [0.0, 1e-13, 1e-9, 1e-6, 1e-3])
def test_clustered_eigenvalues(gap):
    draw = np.random.default_rng(8)
    q = np.linalg.qr(draw.normal(size=(24, 24)))[0]
    values = np.concatenate([[9, 5], 2 + gap * np.arange(6), 1 + gap * np.arange(4), np.geomspace(0.5, 1e-6, 12)])
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.eigenvectors(a)
    assert np.abs(np.sort(found) - np.linalg.eigvalsh(a)).max() < 1e-14 * 9
    assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-15 * 4
    assert np.abs(a @ vectors - vectors * found).max() < 9 * 4e-16 * 4
    lone = np.abs((vectors[:, :2] * q[:, :2]).sum(0))
    assert np.abs(lone - 1).max() < 1e-14


def test_refinement_reaches_double_precision():
    draw = np.random.default_rng(9)
    q = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    values = np.linspace(1, 3, 40)
    a = (q * values) @ q.T
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    _, vectors = whitening.eigenvectors((a + a.T) / 2)
    exact = np.linalg.eigh((a + a.T) / 2)[1][:, ::-1]
    apart = lambda x: np.abs(np.abs((x * exact).sum(0)) - 1).max()
    assert np.abs(np.abs(vectors) - np.abs(exact)).max() < 1e-13
    assert np.abs(np.abs(rough[:, ::-1]) - np.abs(exact)).max() > 1e-7 and apart(vectors) < 1e-14
