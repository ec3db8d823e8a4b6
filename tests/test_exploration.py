"""Valleys of known width, of any scale, one-sided and flat ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.operators import exploration


def frame(spark, data):
    rows = [(s, float(x), float(y), 1.0) for s, (xs, ys) in data.items() for x, y in zip(xs, ys, strict=True)]
    return spark.createDataFrame(rows, "set_id string, x double, y double, yerr double")


def walls(chi2, best, rise):
    """By bisection on either side of a valley that only rises outwards."""
    found = []
    for side in (-1, 1):
        inner, outer = best, best + side * 1e-9 * max(1, abs(best))
        while chi2(outer) <= chi2(best) * (1 + rise):
            outer = best + 2 * (outer - best)
        for _ in range(200):
            middle = (inner + outer) / 2
            inner, outer = (middle, outer) if chi2(middle) <= chi2(best) * (1 + rise) else (inner, middle)
        found.append(outer)
    return found


def test_walls_at_any_scale(spark):
    r = np.random.default_rng(0)
    x = np.linspace(0.1, 2, 60)
    slopes = {"tiny": 3e-5, "one": 1.3, "huge": 4e7, "below": -250.0}
    data = {s: (x, p * x * (1 + 0.1 * r.normal(size=60))) for s, p in slopes.items()}
    guesses = spark.createDataFrame([(s, 1.0) for s in slopes] + [("no rows", 2.0)], "set_id string, guess double")
    got = {q["set_id"]: q for q in exploration.explore(frame(spark, data), guesses, lambda p: p * F.col("x"), ["set_id"], rise=0.3, first=1e-9, tolerance=1e-7).collect()}
    assert set(got) == set(slopes)
    longest = 0
    for s, (a, b) in data.items():
        best = (a * b).sum() / (a * a).sum()
        want = walls(lambda p, a=a, b=b: ((b - p * a) ** 2).sum(), best, 0.3)
        width = want[1] - want[0]
        assert abs(got[s]["p"] - best) < 1e-5 * width
        assert np.allclose([got[s]["low"], got[s]["high"]], want, rtol=0, atol=1e-5 * width)
        even = [((b - p * a) ** 2).sum() for p in np.linspace(*want, 21)]
        assert np.isclose(got[s]["mean_chi2"], np.mean(even), rtol=1e-4)
        longest = max(longest, 4 + 2 + np.ceil(np.log(2 * max(1, abs(best - 1)) / (width * 1e-7)) / np.log(11)))
    assert got["one"]["rounds"] <= longest  # steps that grow, then brackets from the guess's distance down to the tolerance


def test_crooked_open_and_flat_valleys(spark):
    x = np.linspace(0, 1, 20)
    data = {"steep": (x, np.exp(2 * x) + 0.1 * np.cos(9 * x)), "level": (0 * x, x)}
    guesses = spark.createDataFrame([("steep", 0.5), ("level", 0.5)], "set_id string, guess double")
    got = {q["set_id"]: q for q in exploration.explore(frame(spark, data), guesses, lambda p: F.exp(p * F.col("x")), ["set_id"], rise=2.0, widest=2.0**30).collect()}
    a, b = data["steep"]

    def chi2(p):
        return ((b - np.exp(p * a)) ** 2).sum()

    grid = np.linspace(1.9, 2.1, 200_001)
    best = grid[np.argmin([chi2(p) for p in grid])]
    assert abs(got["steep"]["p"] - best) < 1e-5 and np.allclose([got["steep"]["low"], got["steep"]["high"]], walls(chi2, best, 2.0), atol=1e-5)
    flat = got["level"]
    assert flat["low"] is None and flat["high"] is None and flat["mean_chi2"] is None and flat["chi2"] == pytest.approx(((x - 1) ** 2).sum())


def test_no_series(spark):
    empty = frame(spark, {})
    guesses = spark.createDataFrame([], "set_id string, guess double")
    assert exploration.explore(empty, guesses, lambda p: p, ["set_id"]).collect() == []
