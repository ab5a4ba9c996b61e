"""Queries whose pairs of rows, or of pixels and taps, once went through shuffles: the plan holds none, and odd rows come out as the SQL has them."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ombrix.operators import spatial, views
from ombrix.plans import catalogue_views

NAN = float("nan")


def lineitem(n=400, odd=True, seed=5, unsure=True):
    """Rows of three objects; odd: nulls, NaN and infinities among places and colours (NaN only if unsure), repeated rows, an object without a key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        r = [i, rng.randrange(200), rng.choice([1, 2, 2, 3]), rng.randrange(1, 8), float(rng.randrange(1, 51)), rng.uniform(900, 105000), rng.randrange(11) / 100, rng.randrange(9) / 100, rng.choice("RAN"), "O"]
        if odd and i % 7 == 0:
            r[[4, 6, 7, 5][i // 7 % 4]] = None
        if odd and i % 41 == 0:
            r[4] = rng.choice([NAN, math.inf])
        if odd and unsure and i % 29 == 0:
            r[6] = NAN
        if odd and i % 97 == 0:
            r[2] = None
        if odd and i % 53 == 0:
            r[1] = None
        rows.append(r)
    if odd:
        rows += [list(rows[i]) for i in range(1, 30, 3)]
        for i in range(300, 320):  # one id at two places
            r = list(rows[i])
            r[4] = float(rng.randrange(1, 51))
            rows.append(r)
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.float64()] * 4 + [pa.string()] * 2
    arrays = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))]
    return pa.table([*arrays, pa.array([0] * len(rows), pa.timestamp("us"))], names=[*names, "l_shipdate"])


def both(spark, tmp_path, table, name):
    pq.write_table(table, tmp_path / "lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = catalogue_views.QUERIES[name](spark, str(tmp_path))
    plain = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    return plain(got.collect()), plain(db.execute(catalogue_views.ORACLE_SQL[name]).fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["band_knn_median", "frame_dssim", "psnr"])
def test_objects_are_dealt_once(spark, tmp_path, name):
    pq.write_table(lineitem(), tmp_path / "lineitem.parquet")
    p = plan(catalogue_views.QUERIES[name](spark, str(tmp_path)))
    assert p.count("Exchange") == 1 and "Join" not in p


@pytest.mark.parametrize("odd", [False, True])
def test_band_medians_as_sql_has_them(spark, tmp_path, odd):
    got, want = both(spark, tmp_path, lineitem(odd=odd), "band_knn_median")
    assert len(want) > 50 and got == want


@pytest.mark.parametrize("n,levels", [(60, 3), (900, 40), (3000, 4), (3000, 9), (4000, 10**6)])
def test_nearest_rows_are_those_of_all_pairs(n, levels):
    rng = np.random.default_rng(n + levels)
    place = rng.integers(0, levels, (n, 3)) / 7.0
    known = np.ones(n, dtype=bool)
    for odd in (False, True):
        if odd:
            place[rng.integers(0, n, 9), 0] = [NAN, math.inf, -math.inf, NAN, math.inf, 1e200, -1e200, 1e200, NAN]
            known[rng.integers(0, n, 5)] = False
        asked = np.arange(0, n, 3)
        got = np.sort(spatial.nearest_rows(place, known, asked, 13), axis=1)
        with np.errstate(all="ignore"):
            assert all(sorted(spatial.ranked(place, known, asked[i : i + 1], 13)) == got[i].tolist() for i in range(len(asked)))


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("name", ["frame_dssim", "psnr", "zbuffer_render"])
def test_frames_as_sql_has_them(spark, tmp_path, name, odd):
    got, want = both(spark, tmp_path, lineitem(2000, odd=odd, unsure=False), name)
    assert len(want) > 2 and got == want


@pytest.mark.parametrize("far", [1, 3, 40, 10**6])
def test_window_sums_are_those_of_all_pixels(far):
    rng = np.random.default_rng(far)
    px, py = rng.integers(-40, 40, 300) * far, rng.integers(0, 400, 300) * far
    px[:5], py[:5] = px[5:10], py[5:10]  # a pixel may come twice
    values, kernel = rng.normal(size=(300, 2)), views.window_kernel(7, 2.0)
    values[::30, 1] = NAN
    weight = lambda d: np.where(np.abs(d) <= 3, np.array(kernel)[np.clip(d + 3, 0, 6)], 0.0)
    w = weight(px[:, None] - px[None, :]) * weight(py[:, None] - py[None, :])
    want = np.array([[values[w[i] > 0, j] @ w[i][w[i] > 0] for j in range(2)] for i in range(300)])
    got = views.window_sums(px, py, values, kernel, rows=50)
    assert np.isfinite(want[:, 1]).any() and np.allclose(got, want, rtol=1e-12, atol=1e-12, equal_nan=True)


def test_frames_without_weight_or_pairs(spark):
    rows = [(1, 0, 0, 0.5, 0.25, 1.0), (1, 1, 0, None, 0.25, 1.0), (2, 0, 0, 0.5, 0.5, None), (3, 5, 5, 0.5, 0.0, 0.0), (None, 0, 0, 0.5, 0.5, 1.0), (4, None, 0, 0.5, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "k int, px int, py int, v double, o double, weight double")
    pairs = df.select("k", "px", "py", "weight", *[df.v.alias(c) for c in "rgb"], *[df.o.alias(f"o_{c}") for c in "rgb"])
    got = {r.k: r for r in views.weighted_l1_dssim(pairs, "k").collect()}
    assert sorted(got) == [1, 2, 3]
    assert abs(got[1].l1 - 0.25 / 2) < 1e-12 and got[2].l1 is None and got[2].loss is None and got[3].l1 == 0
