"""The counted grid against grids built anew."""

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from pointmill.operators import grid_state as gs

LOW = (0.0, 0.0, 0.0)


def cloud(spark, seed=1):
    r = np.random.default_rng(seed)
    rows = [(int(r.integers(3)), "w" if r.random() < 0.3 else "a", *map(float, r.uniform(3, 9, 3))) for _ in range(60)]
    rows += rows[:5]
    return rows, spark.createDataFrame([*rows, (1, "a", None, 1.0, 1.0)], "body long, kind string, x double, y double, z double")


def brute(rows):
    out = {}
    for body, kind, *xyz in rows:
        at = [int(np.floor(v + 0.5)) for v in xyz]
        for o in product(range(-2, 3), repeat=3):
            d = sum(v * v for v in o)
            role = (gs.WATER_CENTRE if d == 0 else gs.WATER_AREA if d <= 1 else 0) if kind == "w" else (gs.ATOM_CENTRE if d == 0 else gs.ATOM_AREA if d <= 1 else gs.VOLUME if d <= 4 else 0)
            if role:
                key = (body, role, *(a + v for a, v in zip(at, o)))
                out[key] = out.get(key, 0) + 1
    return out


def counted(grid):
    return {tuple(r)[:5]: r["n"] for r in grid.select(*gs.KEYS, "n").collect()}


def test_add_and_remove(spark):
    rows, points = cloud(spark)
    whole = gs.contributions(points, LOW).cache()
    assert counted(whole) == brute(rows)
    one, others = (gs.contributions(points.where(c), LOW) for c in ("body = 1", "body <> 1"))
    assert counted(gs.add(others, one)) == brute(rows)
    assert counted(gs.take_away(whole, one)) == counted(others) == counted(gs.without_bodies(whole, spark.createDataFrame([(1,)], "body long")))
    assert counted(gs.take_away(gs.add(whole, one), one)) == brute(rows)
    assert counted(gs.without_waters(whole)) == brute([r for r in rows if r[1] != "w"])
    nothing = gs.contributions(points.where("false"), LOW)
    assert counted(nothing) == {} and counted(gs.add(whole, nothing)) == brute(rows) and gs.volume(gs.states(nothing)).first()["voxels"] == 0


def test_states_and_their_tests(spark):
    rows, points = cloud(spark, 2)
    holes = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (6, 6, 6)], "i long, j long, k long")
    grid = gs.with_vacuum(gs.contributions(points, LOW), holes)
    want = {}
    for (_, role, *at), _ in brute(rows).items():
        want[tuple(at)] = want.get(tuple(at), 0) | role
    for at in ((0, 0, 0), (6, 6, 6)):
        want[at] = want.get(at, 0) | gs.VACUUM
    states = gs.states(grid).cache()
    assert {(r["i"], r["j"], r["k"]): r["state"] for r in states.collect()} == want
    held = sum(v & (gs.ATOM_CENTRE | gs.ATOM_AREA | gs.VOLUME) > 0 for v in want.values())
    assert tuple(gs.volume(states, 0.5).first()) == (held, held / 8)
    asked = spark.range(12).select(F.col("id").alias("i")).join(spark.range(12).select(F.col("id").alias("j"))).join(spark.range(12).select(F.col("id").alias("k")))
    found = gs.tested(asked, states).collect()
    assert len(found) == 12**3
    for r in found:
        s = want.get((r["i"], r["j"], r["k"]), 0)
        v, a, w = s & gs.VOLUME > 0, s & gs.ATOM_AREA > 0, s & (gs.WATER_AREA | gs.WATER_CENTRE) > 0
        assert [r["is_empty"], r["is_volume"], r["is_only_volume"], r["is_only_empty_or_volume"]] == [s == 0, v, s == gs.VOLUME, s in (0, gs.VOLUME)]
        assert [r["is_empty_or_water"], r["is_empty_or_volume_or_water"], r["is_empty_or_volume"]] == [s == 0 or w, s == 0 or v or w, s == 0 or v]
        assert [r["is_atom_area_or_volume"], r["is_only_atom_area_or_volume"], r["is_atom_area"]] == [a or v, s in (gs.VOLUME, gs.ATOM_AREA, gs.VOLUME | gs.ATOM_AREA), a]
        assert [r["is_atom_center"], r["is_only_atom_center"], r["is_water_center"], r["is_water_area"]] == [s & 4 > 0, s == 4, s & 16 > 0, s & 32 > 0]
