"""Nearest neighbours among close copies and at any scale: the whole answer, as brute force gives it."""

import numpy as np
import pytest

from ombrix.llm import ann


def brute(x, query, k=10):
    d = np.sqrt(((x - x[query]) ** 2).sum(1))
    return [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != query][:k]


def near_copies(jitter):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    group = rng.permutation(1500)[:600]
    group = np.unique(np.append(group, np.arange(0, 1500, 100)))
    x[group] = x[7] + jitter * rng.normal(size=(len(group), 16))
    return x


def isotropic(norm):
    x = np.random.default_rng(6).normal(size=(1500, 16))
    return norm * x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("x", [near_copies(1e-3), near_copies(1e-7), isotropic(1e-3), isotropic(1e-12), isotropic(1e-3) + 1e4, isotropic(1e-4), isotropic(1.0), isotropic(1e19)], ids=["close", "closer", "small", "tiny", "far", "1e-4", "1", "1e19"])
def test_close_and_small_vectors_are_all_compared(spark, x):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.search(df, lambda i: i % 100 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: brute(x, q) for q in range(0, 1500, 100)}


def test_every_length_has_its_neighbours(spark):
    x, y = isotropic(1.0)[:300], isotropic(2.0)[300:340, :5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300 + i, [float(v) for v in r]) for i, r in enumerate(y)] + [(400, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.search(df, lambda i: i % 100 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {**{q: brute(x, q) for q in (0, 100, 200)}, 300: [300 + i for i in brute(y, 0)]}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (100, [1.0, 0.0]), (7, [1.0, 0.5]), (7, [2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(df, lambda i: i % 100 == 0).collect()] == [(100, 1, 7, 0.5)]
    assert ann.search(df.limit(0), lambda i: i % 100 == 0).count() == 0
