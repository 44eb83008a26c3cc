"""Bidiagonal solver and whitening against numpy and exact integers."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from spendlens.llm import bidiagonal, whitening

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(0)
LEFT, RIGHT = (np.linalg.qr(rng.standard_normal((40, 40)))[0] for _ in range(2))
CASES = {
    "one": np.array([[3.0]]), "two": rng.standard_normal((2, 2)), "random": rng.standard_normal((64, 64)), "equal": np.eye(30),
    "repeated": LEFT @ np.diag([5.0] * 10 + [3.0] * 10 + [1.0] * 20) @ RIGHT, "close": LEFT @ np.diag(1 + 1e-9 * np.arange(40)) @ RIGHT,
    "rank 7": LEFT @ np.diag([3.0] * 5 + [1, 0.5] + [0.0] * 33) @ RIGHT, "graded": LEFT @ np.diag(10.0 ** -np.arange(0, 20, 0.5)) @ RIGHT,
    "twins": np.repeat(rng.standard_normal((40, 20)), 2, axis=1), "huge": rng.standard_normal((20, 20)) * 1e150, "zero": np.zeros((5, 5)),
    "glued": np.diag(np.abs(np.arange(-10, 11)) + 1e-3) + np.diag(np.ones(20), 1),
}


@pytest.mark.parametrize("name", CASES)
def test_right_vectors(name):
    a = CASES[name]
    values, vectors = bidiagonal.right_vectors(a, len(a))
    expected = np.linalg.svd(a, compute_uv=False) ** 2
    top = max(expected[0], 1e-300)
    assert np.all(np.diff(values) <= 0) and np.allclose(values / top, expected / top, rtol=0, atol=1e-13)
    live = values > 1e-20 * top
    assert np.abs(vectors[:, live].T @ vectors[:, live] - np.eye(live.sum())).max(initial=0) < 1e-9
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max() <= 1e-12 * top


def test_small_values_keep_their_digits():
    """A graded bidiagonal matrix loses no relative accuracy, which forming b'b would."""
    q, e = 10.0 ** -np.arange(0, 24, 2), 10.0 ** -np.arange(1, 23, 2) * 0.3
    values = bidiagonal.qd_values(q, e)
    assert math.isclose(math.prod(map(float, values)), math.prod(map(float, q)), rel_tol=1e-12)


def plain(vectors, k):
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = ((n * fit - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1]
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    w = ((n * x - sums) / n).astype(float) @ axes[:, order[:k]]
    return n, deviation, w, values[order], values.sum()


def check(rows, vectors, k):
    n, deviation, w, values, trace = plain(vectors, k)
    by_component = {}
    for r in rows:
        assert r["n"] == n and (r["identity_error"] is None or r["identity_error"] <= 1e-8)
        by_component.setdefault(r["component"], []).append(r)
    assert sorted(by_component) == list(range(1, k + 1))
    for c, got in by_component.items():
        got.sort(key=lambda r: r["vec_id"])
        assert [int(r["deviation"]) for r in got] == deviation
        if values[c - 1] > 1e-9 * values[0]:
            mine, theirs = np.array([r["whitened"] for r in got]), w[:, c - 1] / np.sqrt(values[c - 1])
            assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-7
            assert got[0]["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-9)
        else:
            assert all(r["whitened"] is None and r["explained"] == 0 for r in got)


def test_query_against_plain_form(spark):
    query = entry.queries()["op11_whitening"](spark, SF)
    assert [f.dataType.simpleString() for f in query.schema] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    vectors = [v for _, v in sorted(duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall())]
    check(query.collect(), vectors, 16)


SCHEMA = "vec_id long, embedding array<double>, n string, x int, dim string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "n", 1, "d") for i, v in vectors], SCHEMA)


def test_nulls_copies_and_odd_lengths(spark):
    base = np.random.default_rng(3).standard_normal((300, 5)).tolist()
    base += [base[0]] * 400  # one hot vector counts once
    odd = [(None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [3.0, 5.0]), (8, [1.0, 5.0])]
    bad = [(1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0, 1.0]), (1003, [float("nan")] * 5), (1004, [float("inf")] * 5)]
    got = whitening.whitened(table(spark, [*enumerate(base), *odd, *bad]).repartition(13), 16).collect()
    fives = [r for r in got if r["n"] != 3]
    assert len(got) - len(fives) == 2 * len(odd) and {r["vec_id"] for r in got if r["n"] == 3} == {None, 7, 8}
    check(fives, base, 5)


def test_no_variance_and_empty_table(spark):
    same = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    line = [[float(i), 2.0 * i, 0.0] for i in range(20)]
    check(whitening.whitened(table(spark, list(enumerate(line)))).collect(), line, 3)
    assert whitening.whitened(table(spark, [])).collect() == []


def test_components_beyond_whole_numbers(spark):
    got = whitening.whitened(table(spark, [(1, [1e300, 0.5]), (2, [-1e300, 0.25]), (3, [0.0, 0.0])])).collect()
    assert len(got) == 6 and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)
    assert all(r["whitened"] is None or math.isfinite(r["whitened"]) for r in got)


def test_triangles_fold_over_many_tasks(spark):
    vectors = np.random.default_rng(5).standard_normal((600, 4)).tolist()
    fit = whitening.grid(table(spark, list(enumerate(vectors))).repartition(30), "vec_id", "embedding").select("x", "dim")
    known = whitening.centres(fit)
    r = whitening.triangles(fit, known)[4]
    x = np.array([[math.floor(64 * c) for c in v] for v in vectors], dtype=float)
    x -= x.mean(0)
    assert np.allclose(r.T @ r, x.T @ x, rtol=1e-10, atol=1e-6)
