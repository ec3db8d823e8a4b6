import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.operators import dataset, fitting, spline, windows
from pointmill.ordered import neighbours, number_rows


def make(spark, ys, xs=None, errors=None):
    xs = xs if xs is not None else range(len(ys))
    rows = [(0, i, len(ys), float(x), float(y), float(errors[i]) if errors is not None else 1.0) for i, (x, y) in enumerate(zip(xs, ys, strict=True))]
    return spark.createDataFrame(rows, "set_id long, i long, n long, x double, y double, yerr double")


def values(df, c="y"):
    return [r[c] for r in df.orderBy("i").collect()]


def test_numbers_cross_chunks(spark):
    df = spark.createDataFrame([(s, t) for s in "ab" for t in range(50)], "s string, t long")
    out = number_rows(df, ["s"], ["t"], F.floor(F.col("t") / 7)).collect()
    assert all(r["i"] == r["t"] and r["n"] == 50 for r in out) and len(out) == 100


def test_neighbours_cross_blocks(spark):
    out = neighbours(make(spark, range(53)), ["set_id"], {"a": ("y", -3), "b": ("y", 2)}, size=10)
    for r in out.collect():
        assert r["a"] == (r["y"] - 3 if r["i"] >= 3 else None)
        assert r["b"] == (r["y"] + 2 if r["i"] <= 50 else None)
    assert out.count() == 53


@pytest.mark.parametrize("size", [5, 1000])
def test_moving_average(spark, size):
    ys = np.random.default_rng(0).normal(size=31)
    out = values(windows.moving_average(make(spark, ys), 7, size=size))
    for i in range(31):
        s = min(i, 30 - i, 3)
        w = [1.5 ** -abs(k) for k in range(-s, s + 1)]
        assert abs(out[i] - np.average(ys[i - s : i + s + 1], weights=w)) < 1e-12
    with pytest.raises(ValueError):
        windows.moving_average(make(spark, ys), 4)


def test_split_by_change_crosses_blocks(spark):
    ys = [1, 1, 2, 2, 2, 1, 3, 3, 3, 3, 1]
    assert values(windows.split_by_change(make(spark, ys), "y", size=3), "part") == [0, 0, 1, 1, 1, 2, 3, 3, 3, 3, 4]


def test_minima_of_a_ramp_and_a_v(spark):
    assert values(windows.local_minima(make(spark, range(10))), "i") == [0, 9]
    assert values(windows.local_minima(make(spark, [abs(k - 4) for k in range(9)])), "i") == [0, 4, 8]


def test_prominent_minima(spark):
    xs = np.linspace(0, 4 * math.pi, 200)
    out = spline.find_minima(make(spark, np.cos(xs) + 0.01 * np.sin(40 * xs), xs), min_prominence=0.5).collect()
    assert sorted(round(r["x"] / math.pi) for r in out) == [1, 3]


@pytest.mark.parametrize("size", [70, 10_000])
def test_spline_is_the_natural_one(spark, size):
    xs = np.sort(np.random.default_rng(1).uniform(0, 10, 150))
    ys = np.sin(xs)
    n, h = len(xs), np.diff(xs)
    a = np.zeros((n, n))
    b = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((ys[i + 1] - ys[i]) / h[i] - (ys[i] - ys[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    out = spline.coefficients(make(spark, ys, xs), size).orderBy("i").collect()
    assert len(out) == n - 1
    assert max(abs(2 * r["c2"] - m[r["i"]]) for r in out) < 1e-8


def test_interpolation_at_and_beyond(spark):
    xs = np.linspace(0, 3, 40)
    at = spark.createDataFrame([(0, v) for v in (0.0, 0.51, 1.23, 3.0, 3.05)], "set_id long, x double")
    out = {r["x"]: r["y"] for r in spline.interpolate_at(make(spark, np.exp(xs), xs), at).collect()}
    assert len(out) == 5
    assert all(abs(out[v] - math.exp(v)) < (0.5 if v > 3 else 0.05) for v in out)
    assert abs(out[1.23] - math.exp(1.23)) < 1e-4
    assert spline.interpolate_between(make(spark, np.exp(xs), xs), 2).count() == 39 * 3


def fold(xs):
    out, i = [], 0
    while i < len(xs):
        size = 8 if xs[i] > 0.1 else 4 if xs[i] > 0.06 else 2 if xs[i] > 0.03 else 1
        out.append(list(range(i, min(i + size, len(xs)))))
        i += size
    return out


@pytest.mark.parametrize("n", [5, 37, 200, 1001])
def test_rebin_folds(spark, n):
    xs = np.linspace(0.001, 0.2, n)
    ys = np.arange(n, dtype=float)
    got = dataset.rebin(make(spark, ys, xs, np.full(n, 2.0))).orderBy("fold").collect()
    want = fold(xs)
    assert [r["fold"] for r in got] == [g[0] for g in want]
    assert all(abs(r["y"] - ys[g].mean()) < 1e-9 and abs(r["yerr"] - 2 / math.sqrt(len(g))) < 1e-9 for r, g in zip(got, want, strict=True))


def test_reduce(spark):
    assert values(dataset.reduce_linear(make(spark, range(100)), 10), "i") == list(range(0, 100, 10))
    assert dataset.reduce_linear(make(spark, range(5)), 10).count() == 5
    xs = np.logspace(-3, 0, 500)
    got = values(dataset.reduce_log(make(spark, xs, xs), 20), "x")
    assert 18 <= len(got) <= 21 and got[0] == xs[0]


def test_limits_scale_append(spark):
    df = make(spark, [3, 1, 2, 5], [1, 5, 2, 1])
    assert dataset.limit_x(df, 0, 3, sorted_x=False).count() == 1
    assert dataset.limit_x(df, 0, 3).count() == 3
    assert values(dataset.normalize(df, 6.0)) == [6, 2, 4, 10]
    assert dataset.append(df, df).count() == 8
    assert dataset.equal(df, df) and not dataset.equal(df, dataset.append(df, df))
    with pytest.raises(ValueError):
        dataset.append(df, df.drop("y"))
    with pytest.raises(ValueError):
        dataset.select_columns(df, [])
    assert dataset.select_columns(df, [3, 4]).columns == ["x", "y"]


def test_regression_and_searches(spark):
    xs = np.linspace(0, 1, 50)
    df = make(spark, 3 * xs + 2, xs, 1 + xs)
    r = fitting.regression(df, ["set_id"]).first()
    assert abs(r["a"] - 3) < 1e-9 and abs(r["b"] - 2) < 1e-9
    p, c = fitting.refine(df, 0.0, 10.0, lambda a: a * F.col("x") + 2)
    assert abs(p - 3) < 1e-3 and c < 1e-3
    assert fitting.landscape(df, [2.0, 3.0], [2.0], lambda a, b: a * F.col("x") + b).orderBy("chi2").first()["p1"] == 3.0
    scan = fitting.grid_scan(df, [2.0, 3.0, 4.0], lambda a: a * F.col("x") + 2, ["set_id"])
    assert fitting.best(scan, ["set_id"]).first()["p"] == 3.0
