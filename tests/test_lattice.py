"""Histograms of points on a lattice against every pair, and which points go that way."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointmill.operators import lattice, map_fit, map_water, pairs, tiles


def cloud(n, seed=1, box=(13, 60, 9)):
    r = np.random.default_rng(seed)
    at = np.stack([r.integers(-3, k - 3, n) for k in box], 1).astype(float)
    return pd.DataFrame({"id": np.arange(n), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "w": r.choice([1.0, 2.5], n), "kind": r.choice(["a", "w"], n), "level": r.integers(1, 3, n).astype("int32"), "band": r.integers(1, 5, n).astype("int32")})


def brute(p, q, width, same):
    """bin: value, cnt, dsum of all pairs, each twice, and of each point with itself."""
    d = np.sqrt(((p[["x", "y", "z"]].to_numpy()[:, None] - q[["x", "y", "z"]].to_numpy()[None]) ** 2).sum(2))
    w = p["w"].to_numpy()[:, None] * q["w"].to_numpy()[None]
    bins, times = np.floor(d / width + 0.5).astype(int).ravel(), 1 if same else 2
    out = {}
    sums = [np.bincount(bins, v.ravel()) * times for v in (w, np.ones_like(d), d)]
    for b in np.unique(bins):
        out[b] = sums[0][b], sums[1][b], sums[2][b]
    return out


def check(rows, expected):
    assert {r["bin"] for r in rows} == set(expected)
    for r in rows:
        assert (r["value"], r["cnt"], r["dsum"]) == (pytest.approx(expected[r["bin"]][0], rel=1e-12), expected[r["bin"]][1], pytest.approx(expected[r["bin"]][2], rel=1e-9))


@pytest.fixture
def no_tiles(monkeypatch):
    def tasks(*_, **__):
        raise AssertionError("pairs of tiles")

    monkeypatch.setattr(tiles, "tasks", tasks)


def test_every_pair_of_kinds(spark, no_tiles):
    p = cloud(4_300)
    points = spark.createDataFrame(p)
    assert p[["x", "y", "z"]].drop_duplicates().shape[0] < len(p)  # points of one place are pairs too
    for width in (0.25, 0.3):
        rows = lattice.histograms(points, [], ["kind"], width).collect()
        for a, b in (("a", "a"), ("a", "w"), ("w", "w")):
            check([r for r in rows if (r["kind_a"], r["kind_b"]) == (a, b)], brute(p[p["kind"] == a], p[p["kind"] == b], width, a == b))
    check(pairs.pair_histogram(points).collect(), brute(p, p, 0.25, True))


def test_levels_of_a_map_without_pairs(spark, no_tiles):
    p = cloud(5_000, box=(30, 70, 31))
    p["w"] = 1.0
    points = spark.createDataFrame(p).dropDuplicates(["x", "y", "z"])
    p = points.toPandas()
    rows = map_fit.cutoff_histograms(points, 3).collect()
    placed = cloud(700, seed=2, box=(33, 71, 31)).drop_duplicates(["level", "x", "y", "z"]).assign(w=2.0)
    both = map_water.histograms(points, spark.createDataFrame(placed[["level", "x", "y", "z", "w"]]), 3).collect()
    for level in (1, 2, 3):
        own, others = p[p["band"] >= level], placed[placed["level"] == level]
        check([r for r in rows if r["level"] == level], brute(own, own, 0.25, True))
        check([r for r in both if (r["level"], r["kind"]) == (level, "aa")], brute(own, own, 0.25, True))
        check([r for r in both if (r["level"], r["kind"]) == (level, "aw")], brute(own, others, 0.25, False) if len(others) else {})
        check([r for r in both if (r["level"], r["kind"]) == (level, "ww")], brute(others, others, 0.25, True) if len(others) else {})


def test_groups_blocks_and_flat_boxes(spark, monkeypatch):
    """Blocks of one frequency and rows of one step give the same, as do boxes one place thick."""
    monkeypatch.setattr(lattice, "BLOCK", 1)
    monkeypatch.setattr(lattice, "STEPS", 1)
    for box in ((5, 6, 4), (1, 9, 3), (1, 1, 40), (1, 1, 1)):
        p = cloud(900, box=box)
        rows = lattice.histograms(spark.createDataFrame(p), ["level"], [], 0.25).collect()
        for level in (1, 2):
            own = p[p["level"] == level]
            check([r for r in rows if r["level"] == level], brute(own, own, 0.25, True))


def test_others_go_by_tiles(spark):
    p = cloud(900, box=(5, 5, 5))
    halves, wide = p.assign(x=p["x"] + 0.5), p.assign(x=p["x"] * 1000)
    kinds = p.assign(w=np.arange(len(p)) * 1.0)
    for odd in (halves, wide, kinds):
        assert lattice.histograms(spark.createDataFrame(odd), [], [], 0.25) is None
    points = spark.createDataFrame(p)
    assert lattice.histograms(points.where("false"), [], [], 0.25) is None
    for c in ("x", "w", "kind"):
        assert lattice.histograms(points.withColumn(c, F.when(F.col("id") > 3, F.col(c))), [], ["kind"], 0.25) is None
    assert lattice.histograms(points.withColumn("z", F.lit(float("nan"))), [], [], 0.25) is None
    assert lattice.histograms(points, [], [], 0.25) is not None


def test_fast_lengths():
    assert [lattice.fast_length(n) for n in (1, 2, 7, 11, 91, 187, 11_261, 65_537)] == [1, 2, 8, 12, 96, 192, 11_520, 65_610]
