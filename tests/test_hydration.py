"""Waters that keep apart, and radial scores, against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.operators import grid_volume, hydration, voxels
from pointmill.ordered import first_rows


def cloud(spark, n, seed, size=12.0):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, *map(float, r.uniform(0, size, 3)), 1.0, "a") for i in range(n)], "id long, x double, y double, z double, w double, kind string")


def one_by_one(rows, spacing):
    placed = []
    for r in sorted(set(rows), key=lambda r: (-r[4], *r[:4])):
        if all(sum((a - b) ** 2 for a, b in zip(r[1:4], p[1:4])) >= spacing * spacing for p in placed):
            placed.append(r)
    return sorted(placed)


@pytest.mark.parametrize("seed,levels,spacing", [(1, 3, 2.0), (2, 50, 1.0), (3, 1, 4.0)])
def test_spacing_is_that_of_placing_one_by_one(spark, seed, levels, spacing):
    r = np.random.default_rng(seed)
    rows = [(int(i), *map(float, r.uniform(0, 8, 3)), int(r.integers(levels))) for i in range(250)]
    rows += rows[:20] + [(900, 1.0, 1.0, 1.0, 2), (901, 1.0, 1.0, 1.0, 2)]
    frame = spark.createDataFrame(rows, "of long, x double, y double, z double, score long")
    assert sorted(tuple(x) for x in hydration.spaced(frame, spacing).collect()) == one_by_one(rows, spacing)
    assert hydration.spaced(frame.where("false"), spacing).count() == 0


def test_a_chain_of_candidates(spark):
    """Each beats the next: rounds follow the chain, every second stays."""
    rows = [(i, i * 1.5, 0.0, 0.0, 100 - i) for i in range(13)]
    kept = hydration.spaced(spark.createDataFrame(rows, "of long, x double, y double, z double, score long"), 2.0)
    assert sorted(x["of"] for x in kept.collect()) == list(range(0, 13, 2))


@pytest.mark.parametrize("strategy", ["axes", "radial"])
def test_no_two_waters_are_too_near(spark, strategy):
    p = cloud(spark, 70, 5)
    rows = hydration.hydrate(p, strategy=strategy, noise=0.1 if strategy == "radial" else 0.0, waters=10_000).collect()
    atoms, waters = (np.array([[x["x"], x["y"], x["z"]] for x in rows if x["kind"] == k]) for k in "aw")
    assert len(atoms) == 70 and len(waters) > 20
    gaps = np.sqrt(((waters[:, None] - waters[None]) ** 2).sum(axis=2))[np.triu_indices(len(waters), 1)]
    assert gaps.min() >= 2.0 and np.sqrt(((waters[:, None] - atoms[None]) ** 2).sum(axis=2)).min() >= 2.5
    again = hydration.hydrate(p.repartition(5), strategy=strategy, noise=0.1 if strategy == "radial" else 0.0, waters=10_000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_strategies_by_name(spark):
    p = cloud(spark, 5, 2)
    assert hydration.hydrate(p, strategy="none", waters=9).count() == 5
    with pytest.raises(ValueError):
        hydration.hydrate(p, strategy="other", waters=9)
    assert hydration.hydrate(p.where("false"), strategy="radial", waters=9).count() == 0


def test_radial_scores_by_loops(spark):
    r = np.random.default_rng(8)
    filled = {tuple(map(int, v)) for v in r.integers(0, 14, (260, 3))}
    frame = spark.createDataFrame([*filled], "i long, j long, k long")
    candidates = [(n, *map(float, r.uniform(-1, 16, 3))) for n in range(40)]
    bins, low, radius = (16, 15, 14), (-1.0, 0.0, 0.5), 1.5
    found = hydration.radial_scores(spark.createDataFrame(candidates, "of long, x double, y double, z double"), frame, low, bins, radius)
    got = {x["of"]: (x["blocked"], x["score"]) for x in found.collect()}
    ways = grid_volume.directions()

    def at(v):
        return int(np.floor(abs(round(v, 9)) + 0.5)) * (1 if v >= 0 else -1)

    for of, *xyz in candidates:
        here = [int(np.floor(c - lo + 0.5)) for c, lo in zip(xyz, low)]
        blocked = score = 0
        for way in ways:
            one, three, five = ([h + at(m * radius * c) for h, c in zip(here, way)] for m in (1, 3, 5))
            inside = [all(0 <= v < b for v, b in zip(place, bins)) for place in (one, three, five)]
            if tuple(min(max(v, 0), b - 1) for v, b in zip(one, bins)) in filled:
                blocked += 1
            elif not inside[1]:
                score += 2
            elif tuple(three) in filled:
                score -= 2
            else:
                score += 2 + (1 if not inside[2] else -1 if tuple(five) in filled else 0)
        assert got[of] == (blocked, score)


def test_first_rows_over_ranges(spark):
    frame = spark.range(1000).select((F.col("id") * 37 % 101).alias("v"), "id")
    want = sorted((x["v"], x["id"]) for x in frame.collect())
    for n in (0, 1, 250, 999, 1000, 5000):
        assert sorted((x["v"], x["id"]) for x in first_rows(frame, [F.asc("v"), F.asc("id")], n, 90).collect()) == want[:n]
    assert voxels.volume(spark.createDataFrame([(0, 0, 0)], "i long, j long, k long")).first()["voxels"] == 1
