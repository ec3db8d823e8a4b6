import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.operators import bodies, hydration, mass, pairs, profiles, symmetry, voxels
from pointmill.streaming import incremental


def cube(spark, centre=False):
    at = [tuple(map(float, p)) for p in itertools.product((-1, 1), repeat=3)] + ([(0.0, 0.0, 0.0)] if centre else [])
    return spark.createDataFrame([(i, *p, 1.0, i % 2) for i, p in enumerate(at)], "id long, x double, y double, z double, w double, body long")


def counts(h):
    return {r["bin"]: (r["value"], r["cnt"]) for r in h.collect()}


def test_cube_distances(spark):
    found = counts(pairs.pair_histogram(cube(spark)))
    want = {0.0: 8, 2.0: 24, math.sqrt(8): 24, math.sqrt(12): 8}
    assert found == {math.floor(d * 4 + 0.5): (n, n) for d, n in want.items()}
    assert counts(pairs.pair_histogram(cube(spark, True)))[math.floor(math.sqrt(3) * 4 + 0.5)] == (16, 16)


def test_cross_histogram_of_the_cube_with_itself(spark):
    found = counts(pairs.cross_histogram(cube(spark), cube(spark)))
    assert found[0] == (16, 16) and found[8] == (48, 48)


def cloud(spark, n, seed):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, *map(float, r.uniform(-10, 10, 3)), float(r.integers(1, 4)), int(r.integers(0, 3))) for i in range(n)], "id long, x double, y double, z double, w double, body long")


@pytest.mark.parametrize("group", [[], ["body"]])
def test_tiles_equal_the_join(spark, monkeypatch, group):
    p = cloud(spark, 150, 1)
    keys = [*(f"body_{s}" for s in "ab" if group), "bin"]
    a = {tuple(r[k] for k in keys): (r["value"], r["cnt"], round(r["dsum"], 6)) for r in pairs.pair_histogram(p, group).collect()}
    x = {tuple(r[k] for k in keys): (r["value"], r["cnt"]) for r in pairs.cross_histogram(p.where("id < 60"), p.where("id >= 60"), group).collect()}
    monkeypatch.setattr(pairs, "BROADCAST_POINTS", 0)
    monkeypatch.setattr(pairs, "TILE", 40)
    b = {tuple(r[k] for k in keys): (r["value"], r["cnt"], round(r["dsum"], 6)) for r in pairs.pair_histogram(p, group).collect()}
    y = {tuple(r[k] for k in keys): (r["value"], r["cnt"]) for r in pairs.cross_histogram(p.where("id < 60"), p.where("id >= 60"), group).collect()}
    assert a == b and x == y


def test_no_points(spark):
    assert pairs.pair_histogram(cube(spark).where("false")).count() == 0


def test_profile_tends_to_the_squared_weight(spark):
    q = spark.createDataFrame([(1e-4,)], "q double")
    p = cube(spark)
    assert abs(profiles.transform(pairs.pair_histogram(p), q).first()["intensity"] - 64) < 1e-3
    assert abs(profiles.exact(p, q).first()["intensity"] - 64) < 1e-3


@pytest.mark.parametrize(("name", "size"), [("c2", 2), ("c7", 7), ("d3", 6), ("t", 12), ("o", 24), ("i", 60), ("c2-c3", 6)])
def test_groups(name, size):
    found = symmetry.group(name)
    assert len(found) == size
    assert all(np.allclose(r @ r.T, np.eye(3)) for r in found)


def test_pair_schedule_counts_all_pairs():
    for name in ("c5", "d4", "t"):
        g = symmetry.group(name)
        assert sum(m for _, m in symmetry.pair_schedule(g)) == len(g)


def test_copies_and_superposition(spark):
    p = cloud(spark, 30, 2).withColumn("body", F.lit(0).cast("long"))
    made = symmetry.copies(p, symmetry.transforms(spark, {0: symmetry.group("c3")}, (1, 2, 3)))
    assert made.count() == 90
    a, b = made.where("copy = 0"), made.where("copy = 1")
    both = a.select("id", *[F.col(c).alias(f"a{c}") for c in "xyz"]).join(b.select("id", *[F.col(c).alias(f"b{c}") for c in "xyz"]), "id")
    rotation, _, rms = symmetry.superpose(both)
    assert rms < 1e-6 and np.allclose(rotation, symmetry.group("c3")[1], atol=1e-6)


@pytest.mark.parametrize(("name", "swapped"), [("c3", False), ("d2", False), ("t", False), ("dp3", True), ("c2-c3", False)])
def test_decomposition(spark, name, swapped):
    p = cloud(spark, 12, 8).withColumn("body", F.lit(0).cast("long"))
    frame, centre = symmetry.rotation((1, -2, 0.5), 0.9), np.array([30.0, -4, 7])
    turned = [frame @ g @ frame.T for g in symmetry.group(name)]
    made = symmetry.copies(p, symmetry.transforms(spark, {0: turned}, tuple(centre)))
    if swapped:
        made = made.withColumn("copy", F.when(F.col("copy") == 1, 3).when(F.col("copy") == 3, 1).otherwise(F.col("copy")))
    found = symmetry.decompose(made, name, accept=1e-4)
    assert found.rms < 1e-4
    assert all(np.allclose(t @ (found.centre - centre), found.centre - centre, atol=1e-4) for t in turned)
    assert symmetry.decompose(made.withColumn("x", F.col("x") * F.when(F.col("copy") == 1, 2).otherwise(1)), name, most=1).rms > 0.5


def test_free_copy(spark):
    one = spark.createDataFrame([(0, 2.0, 1.0, 0.0)], "body long, x double, y double, z double")
    made = symmetry.copies(one, symmetry.free_copy(spark, 0, symmetry.rotation((0, 0, 1), math.pi / 2), (0.0, 0.0, 5.0), (1.0, 1.0, 0.0)))
    assert np.allclose([(r["x"], r["y"], r["z"]) for r in made.orderBy("copy").collect()], [(2, 1, 0), (1, 2, 5)])


def test_incremental_equals_full(spark):
    old = cloud(spark, 80, 3)
    changes = old.where("body = 1").withColumn("x", F.col("x") + 5)
    new = incremental.apply_changes(old, changes)
    kept = incremental.total(incremental.update(incremental.by_body_pairs(old), new, [1]))
    assert counts(kept) == counts(pairs.merge(pairs.pair_histogram(new)))


def test_voxels(spark):
    one = spark.createDataFrame([(0, 0, 0)], "i long, j long, k long")
    ball = voxels.expand(one, 2.0)
    assert ball.count() == 33
    assert voxels.surface(ball).where("NOT surface").count() == 7
    line = spark.createDataFrame([(0, 0, k) for k in (0, 1, 4, 9)], "i long, j long, k long")
    assert sorted(r["k"] for r in voxels.holes(line, 3).collect()) == [2, 3]
    assert hydration.shell_voxels(one, 1.0, 2.0).count() == 33 - 7


def test_body_edits_and_penalties(spark):
    p = cube(spark).withColumns({"residue": F.col("id"), "is_calpha": F.lit(True)})
    assert {r["body"] for r in bodies.split_at(p, 1, [5]).collect()} == {0, 1, 2}
    assert bodies.bonds(p, 4.0).count() == 1
    wanted = spark.createDataFrame([(0, 1, 2.0, "bond"), (0, 1, 3.0, "attract"), (0, 1, 3.0, "repel")], "id_a long, id_b long, rest double, kind string")
    found = {(r["kind"], r["rest"]): r["penalty"] for r in bodies.constraints(p, wanted).collect()}
    assert found == {("bond", 2.0): 0.0, ("attract", 3.0): 0.0, ("repel", 3.0): 10.0}


def test_mass(spark):
    c = mass.centre_of_mass(cube(spark)).first()
    assert (c["cx"], c["cy"], c["cz"], c["mass"]) == (0, 0, 0, 8)
    assert abs(mass.radius_of_gyration(cube(spark)).first()["rg"] - math.sqrt(3)) < 1e-12
    assert mass.implicit_volume(cube(spark), 8.0, 0.5).first()["w"] == 0.5
