"""Waters about the shapes of all cutoffs of a map, against one cutoff after another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.operators import map_fit, map_water, pairs
from pointmill.plans import profile_fit
from pointmill.plans.queries import QUERIES
from tests.test_hydration import one_by_one
from tests.test_points import cloud, counts

LEVELS = 4


def volume(spark, seed=6, share=0.3):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(int(x), int(y), int(z), float(r.uniform(0, 10))) for x, y, z in np.ndindex(7, 6, 5) if r.uniform() < share], "x int, y int, z int, val double")


@pytest.fixture(scope="module")
def points(spark):
    return map_fit.banded_points(volume(spark), LEVELS, 2.0, 10.0).cache()


def brute_places(points, level, shell=3.0, clearance=2.5, reach=5.0):
    at = np.array([[r["x"], r["y"], r["z"]] for r in points.collect() if r["band"] >= level])
    sides = shell * np.array([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])
    out = set()
    for c in {tuple(map(float, p + s)) for p in at for s in sides}:
        d = np.sqrt(((at - np.array(c)) ** 2).sum(axis=1))
        if d.min() >= clearance:
            out.add((*c, int((d <= reach).sum())))
    return out


def test_places_of_every_level(points):
    found = {k: set() for k in range(1, LEVELS + 1)}
    for r in map_water.places(points, LEVELS).collect():
        found[r["level"]].add((r["x"], r["y"], r["z"], r["score"]))
    assert found == {k: brute_places(points, k) for k in found} and len(found[1]) > 10


@pytest.mark.parametrize("shell", [4.0, 6.0])
def test_places_of_other_shells(points, shell):
    found = {k: set() for k in range(1, LEVELS + 1)}
    for r in map_water.places(points, LEVELS, shell, 2.5, 5.0).collect():
        found[r["level"]].add((r["x"], r["y"], r["z"], r["score"]))
    assert found == {k: brute_places(points, k, shell) for k in found}


def test_waters_are_placed_one_by_one_at_every_level(points):
    found = {k: [] for k in range(1, LEVELS + 1)}
    for r in map_water.waters(points, LEVELS, spacing=2.5).collect():
        found[r["level"]].append((0, r["x"], r["y"], r["z"], r["score"]))
    for k, rows in found.items():
        assert sorted(rows) == one_by_one([(0, *p) for p in brute_places(points, k)], 2.5)


def test_histograms_of_every_level(points):
    placed = map_water.waters(points, LEVELS).withColumn("w", F.lit(2.0)).cache()
    found = {}
    for r in map_water.histograms(points, placed, LEVELS).collect():
        found.setdefault((r["level"], r["kind"]), {})[r["bin"]] = (r["value"], r["cnt"])
    for k in range(1, LEVELS + 1):
        shape, own = points.where(F.col("band") >= k), placed.where(F.col("level") == k).withColumn("id", F.xxhash64("x", "y", "z"))
        assert found[k, "aa"] == counts(pairs.pair_histogram(shape))
        assert found[k, "ww"] == counts(pairs.pair_histogram(own))
        assert found[k, "aw"] == counts(pairs.merge(pairs.cross_histogram(shape, own)))


@pytest.mark.parametrize("tile", [7, 1000])
def test_self_joins_within_groups(spark, tile):
    p = cloud(spark, 60, 3)
    found = {}
    for r in pairs.within_histogram(p, ["body"], tile=tile).collect():
        found.setdefault(r["body"], {})[r["bin"]] = (r["value"], r["cnt"])
    assert found == {b: counts(pairs.pair_histogram(p.where(F.col("body") == b))) for b in range(3)}
    assert pairs.within_histogram(p.where("false"), ["body"]).count() == 0


def test_masses_of_every_level(points):
    rows = {r["level"]: (r["cutoff"], r["voxels"], r["mass"]) for r in map_water.masses(points, LEVELS, 2.0, 10.0, 2.0, 0.5).collect()}
    for k in range(1, LEVELS + 1):
        n = points.where(F.col("band") >= k).count()
        assert rows[k] == (2.0 + (k - 1) * 2.0, n, n * 4.0)


def test_a_cutoff_with_waters_is_found_again(spark):
    """A curve of the voxels above 6 and waters of weight 2.5 about them, by fits with waters."""
    v = volume(spark).cache()
    truth = map_fit.banded_points(v, 1, 6.0, 10.0)
    own = map_water.waters(truth.withColumn("band", F.lit(1)), 1).select(F.xxhash64("x", "y", "z").alias("id"), "x", "y", "z", F.lit(2.5).alias("w"), F.lit("w").alias("kind"))
    data = profile_fit.simulate(truth.select("id", "x", "y", "z", "w", F.lit("a").alias("kind")).unionByName(own), 30, by_kind=True)
    found = map_fit.search_cutoff(v, data, 2.0, 10.0, levels=4, rounds=1, most=1, hydrate=True)
    assert v.where((F.col("val") >= found.cutoff) != (F.col("val") >= 6.0)).count() == 0
    assert abs(found.water - 2.5) < 0.01 and found.mass == pytest.approx(v.where("val >= 6").count() * 0.81)
    dry = map_fit.search_cutoff(v, data, 2.0, 10.0, levels=4, rounds=1, most=1)
    assert dry.chi2 > 100 * found.chi2


def test_a_map_without_voxels(points):
    none = points.where("false")
    assert map_water.waters(none, LEVELS).count() == 0
    assert map_water.masses(none, LEVELS, 2.0, 10.0).count() == 0
    assert map_water.histograms(none, map_water.waters(none, LEVELS).withColumn("w", F.lit(1.0)), LEVELS).count() == 0
    with pytest.raises(ValueError):
        map_water.places(points, 65)


def test_the_query_finds_level_and_factor(spark, sf_dir):
    rows = {r["level"]: r for r in QUERIES["map_water_fit"](spark, sf_dir).collect()}
    best = min(rows, key=lambda k: rows[k]["chi2"])
    assert best == 3 and abs(rows[best]["water"] - 3) < 0.01
