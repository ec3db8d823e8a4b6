"""Minima and splines of series, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.operators import fitting, profiles, spline
from pointmill.plans.inputs import series
from pointmill.plans.queries import QUERIES


def brute_minima(y, spacing, least):
    n, span, found = len(y), max(y) - min(y), []
    for k in range(n):
        if not (k in (0, n - 1) or (y[k] < y[k - 1] and y[k] < y[k + 1])):
            continue
        sides = []
        for step in (-1, 1):
            top, j = y[k], k + step
            while 0 <= j < n and y[j] > y[k]:
                top, j = max(top, y[j]), j + step
            if 0 <= j < n:
                sides.append(top)
        height = min(sides) if sides else max(y)
        if (height - y[k]) / max(span, 1e-300) >= least:
            found.append((k, (height - y[k]) / max(span, 1e-300)))
    kept = []
    for k, p in sorted(found, key=lambda f: (y[f[0]], f[0])):
        if all(abs(k - j) >= spacing for j, _ in kept):
            kept.append((k, p))
    return sorted(kept)


def frame(spark, curves):
    rows = [(s, i, len(y), float(i), float(v)) for s, y in curves.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "set_id string, i long, n long, x double, y double")


@pytest.fixture(scope="module")
def curves():
    r = np.random.default_rng(4)
    return {
        "noise": r.normal(size=300).round(1),
        "walk": np.cumsum(r.normal(size=300)),
        "wave": np.sin(np.arange(200) / 7) + 0.2 * r.normal(size=200),
        "ramp": np.arange(50.0),
        "fall": -np.arange(90.0) + (np.arange(90) % 2) * 3,
        "rise": np.arange(90.0) + (np.arange(90) % 3) * 4,
        "flat": np.zeros(30),
        "short": np.array([2.0, 1.0]),
        "vee": np.abs(np.arange(41.0) - 20),
    }


@pytest.mark.parametrize("size, spacing, least", [(100_000, 1, 0.0), (7, 1, 0.0), (16, 4, 0.0), (13, 1, 0.15), (20, 9, 0.1)])
def test_minima_match_brute_force(spark, curves, size, spacing, least):
    got = {s: [] for s in curves}
    for r in spline.find_minima(frame(spark, curves), spacing, least, size=size).collect():
        got[r["set_id"]].append((r["i"], r["prominence"]))
    for s, y in curves.items():
        want = brute_minima(y, spacing, least)
        assert sorted(i for i, _ in got[s]) == [k for k, _ in want], s
        assert np.allclose([p for _, p in sorted(got[s])], [p for _, p in want]), s


def test_minima_of_the_tables_match_brute_force(spark, sf_dir):
    from pointmill.operators import windows

    got = {(r["set_id"], r["i"]): r["prominence"] for r in QUERIES["find_minima"](spark, sf_dir).collect()}
    rows = windows.moving_average(series(spark, sf_dir), 9).orderBy("set_id", "i").toPandas()
    want = {(s, k): p for s, own in rows.groupby("set_id") for k, p in brute_minima(own["y"].to_numpy(), 5, 0.2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def natural_spline(x, y, at):
    """Second derivatives from the full system of equations; beyond the ends, the outermost cubics."""
    n, h = len(x), np.diff(x)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1], a[i, i], a[i, i + 1] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, u = at - x[k], x[k + 1] - at
    return m[k] * u**3 / (6 * h[k]) + m[k + 1] * t**3 / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t


@pytest.mark.parametrize("name", ["spline_at", "spline_interpolate"])
def test_splines_of_the_tables_match_the_equations(spark, sf_dir, name):
    knots = series(spark, sf_dir).orderBy("set_id", "i").toPandas()
    found = QUERIES[name](spark, sf_dir).toPandas()
    for s, own in knots.groupby("set_id"):
        mine = found[found["set_id"] == s].sort_values("x")
        want = natural_spline(own["x"].to_numpy(), own["y"].to_numpy(), mine["x"].to_numpy())
        assert len(mine) and np.allclose(mine["y"], want, rtol=1e-6, atol=1e-6 * np.abs(own["y"]).max())


def test_large_grids_are_rows(spark, curves, monkeypatch):
    df = frame(spark, {"vee": curves["vee"]}).withColumn("yerr", F.lit(1.0))
    few = fitting.grid_scan(df, [0.5 * k for k in range(50)], lambda p: p, ["set_id"]).collect()
    lands = fitting.landscape(df, [0.0, 1.0], [2.0, 3.0], lambda a, b: a + b * F.col("x")).collect()
    monkeypatch.setattr(fitting, "GRID_COLUMNS", 1)
    many = fitting.grid_scan(df, [0.5 * k for k in range(50)], lambda p: p, ["set_id"]).collect()
    assert sorted(few) == sorted(many)
    assert sorted(lands) == sorted(fitting.landscape(df, [0.0, 1.0], [2.0, 3.0], lambda a, b: a + b * F.col("x")).collect())


def test_exact_transform_refuses_many_points(spark, monkeypatch):
    monkeypatch.setattr(profiles, "EXACT_POINTS", 3)
    p = spark.range(4).select("id", *[F.lit(0.0).alias(c) for c in "xyzw"])
    with pytest.raises(ValueError):
        profiles.exact(p, spark.range(1).select(F.lit(0.1).alias("q")))
