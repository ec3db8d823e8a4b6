"""Surfaces by rays, volume on a grid, categories, groups of bodies, scans and searches of cutoffs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill import sinks
from pointmill.operators import categories, density_map, fitting, grid_volume, map_fit, pairs, profiles, rigid, symmetry
from pointmill.plans import profile_fit
from tests.test_points import cloud, counts


def ball(radius):
    n = range(-radius, radius + 1)
    return [(i, j, k) for i in n for j in n for k in n if i * i + j * j + k * k <= radius * radius]


@pytest.mark.parametrize("seed", [None, 3])
def test_rays_equal_a_walk(spark, seed):
    at = ball(4) if seed is None else [tuple(map(int, v)) for v in np.random.default_rng(seed).integers(0, 7, (120, 3))]
    filled, steps = set(at), {}
    for ray, step, *o in grid_volume.ray_steps():
        steps.setdefault(ray, {})[step] = o
    want = {}
    for v in filled:
        score = 0
        for own in steps.values():
            first = next((s for s in (1, 2, 3) if tuple(a + b for a, b in zip(v, own[s], strict=True)) in filled), None)
            score += 7 if first is None else (0, 3, 5)[first - 1]
        want[v] = score
    voxels = spark.createDataFrame(at, "i long, j long, k long")
    assert {(r["i"], r["j"], r["k"]): r["score"] for r in grid_volume.ray_scores(voxels).collect()} == want
    marked = {(r["i"], r["j"], r["k"]): r["surface"] for r in grid_volume.surface_by_rays(voxels).collect()}
    assert marked == {v: s >= 42 for v, s in want.items()}
    if seed is None:
        assert not marked[0, 0, 0] and marked[4, 0, 0]


def test_directions_are_unit_and_apart():
    found = grid_volume.directions(12)
    assert len(found) == 62 == len({tuple(round(c, 4) for c in v) for v in found})
    assert all(abs(sum(c * c for c in v) - 1) < 1e-9 for v in found)


def test_no_voxels(spark):
    none = spark.createDataFrame([], "i long, j long, k long")
    assert grid_volume.ray_scores(none).count() == 0 and grid_volume.surface_by_rays(none, thickness=4.0).count() == 0


def test_grid_profile_is_that_of_all_points(spark):
    atoms = cloud(spark, 25, 1).withColumns({"ff": F.lit(0).cast("long"), "w": F.lit(1.0)})
    marked = grid_volume.surface_by_rays(spark.createDataFrame(ball(3), "i long, j long, k long"))
    cells = grid_volume.voxel_points(marked, (0.5, 0.5, 0.5))
    assert cells.select("id").distinct().count() == len(ball(3)) and cells.where("id >= 0").count() == 0
    q = spark.createDataFrame([(0.1,), (0.3,)], "q double")
    factors = spark.createDataFrame([(0, 0.1, 3.0), (0, 0.3, 2.0), (-1, 0.1, 0.5), (-1, 0.3, 0.25), (-2, 0.1, 0.5), (-2, 0.3, 0.25)], "ff long, q double, f double")
    wide = grid_volume.terms(profiles.transform(grid_volume.histograms(atoms, cells, 0.001), q, ["ff_a", "ff_b"], enveloped=False), factors)
    found = {r["q"]: r["intensity"] for r in grid_volume.profile(wide, 0.9, 1.3).collect()}
    pts = atoms.select("x", "y", "z", "ff").unionByName(cells.select("x", "y", "z", "ff")).collect()
    xyz, ff = np.array([r[:3] for r in pts]), np.array([r[3] for r in pts])
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    for at, (f, x) in {0.1: (3.0, 0.5), 0.3: (2.0, 0.25)}.items():
        w = np.where(ff == 0, f, np.where(ff == -1, -0.9 * x, -0.9 * 1.3 * x))
        want = (w[:, None] * w[None] * np.sinc(at * d / np.pi)).sum()
        assert abs(found[at] - want) < 1e-3 * abs(want)


def test_scaled_cells(spark):
    marked = spark.createDataFrame([(2, 0, 0, True), (4, 4, 0, False)], "i long, j long, k long, surface boolean")
    rows = grid_volume.voxel_points(marked, (1.0, 1.0, 1.0), scale=2.0).orderBy("x").collect()
    assert [(r["x"], r["y"], r["z"], r["ff"]) for r in rows] == [(6.0, 2.0, 2.0, -2), (10.0, 10.0, 2.0, -1)]


def test_categories(spark):
    rows = [("C", "CH2"), ("c", None), ("N", ""), ("O", "OH"), ("Fe", None), ("S", "XY"), (None, None)]
    df = spark.createDataFrame(rows, "element string, grp string")
    assert [r[0] for r in df.select(categories.category(F.col("element"), F.col("grp"))).collect()] == ["CH2", "C", "N", "OH", "OTHER", "S", "OTHER"]
    made = spark.createDataFrame([("C", 3), ("O", 1), ("N", 0)], "e string, h int").select(categories.group_of(F.col("e"), F.col("h")))
    assert [r[0] for r in made.collect()] == ["CH3", "OH", None]
    spheres = {r["category"]: r["volume"] for r in categories.volumes(spark, "spheres").collect()}
    assert abs(spheres["CH2"] - 4 * math.pi / 3 * (1.96**3 + 2 * 1.1**3)) < 1e-9
    atoms = spark.createDataFrame([("CH2",), ("OTHER",), (None,)], "category string")
    assert categories.displaced(atoms, categories.volumes(spark, "traube")).first() == (3, 26.74, 2)
    with pytest.raises(ValueError):
        categories.volumes(spark, "none")
    with pytest.raises(ValueError):
        categories.volumes(spark, custom={"C": 1.0})


def test_scales_of_other_conventions(spark):
    q = spark.createDataFrame([(0.2,)], "q double")
    one = q.select(*[profiles.emulated_scale(F.col("q"), 1.0, n, 20.0).alias(n) for n in ("volume", "radius", "linear")]).first()
    assert one["volume"] == one["radius"] == 1.0
    assert abs(one["linear"] - (4 - 2 * math.pi * (4 * math.pi / 3) ** (2 / 3) * 1.64**2)) < 1e-12


def link(a, b):
    return rigid.Link(a, b, np.array([float(a), 0, 0]), np.array([float(b), 0, 0]))


def test_what_hangs_together():
    chain = [link(0, 1), link(1, 2), link(2, 3)]
    assert rigid.connected(0, chain) == {0, 1, 2, 3} and rigid.connected(2, chain, chain[1]) == {2, 3}
    sizes = {0: 5, 1: 5, 2: 1, 3: 1}
    assert [t[0] for t in rigid.link_targets(chain, sizes)] == [(0,), (2, 3), (3,)]
    assert [tuple(t[1]) for t in rigid.link_targets(chain, sizes)] == [(1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert [t[0] for t in rigid.link_targets(chain, sizes, fixed=(3,))] == [(0,), (0, 1), (0, 1, 2)]
    assert [t[0] for t in rigid.link_targets([*chain, link(3, 0)], sizes)] == [(0,), (1,), (2,), (3,)]


def test_masks_and_orders():
    rng = np.random.default_rng(1)
    targets = rigid.body_targets({0: np.ones(3), 1: np.zeros(3), 2: np.ones(3)}, fixed=(1,))
    turned = rigid.draw(targets, 4, 0.5, 3.0, rng, sequential=True, first=1, mask="rotation")
    assert [m[0] for m in turned] == [(0,), (2,), (0,), (2,), (0,)] and np.allclose(turned[1][1] @ np.ones(3) + turned[1][2], np.ones(3))
    assert all(np.allclose(m[1], np.eye(3)) for m in rigid.draw(targets, 4, 0.5, 3.0, rng, mask="translation"))
    with pytest.raises(ValueError):
        rigid.draw([], 1, 0.5, 1.0, rng)


def test_moves_of_groups_equal_whole_histograms(spark, monkeypatch):
    p = cloud(spark, 90, 4)
    r, t = symmetry.rotation((0, 1, 1), 0.7), np.array([1.0, 2, 3])
    want = [counts(pairs.pair_histogram(rigid.place(p, {b: (r, t) if b in g else (np.eye(3), np.zeros(3)) for b in range(3)}))) for g in ((0, 2), (1,))]
    for most in (20_000, 0):
        monkeypatch.setattr(pairs, "BROADCAST_POINTS", most)
        monkeypatch.setattr(pairs, "TILE", 25 if not most else 4096)
        found = {}
        for row in rigid.move_histograms(p, [((0, 2), r, t), (1, r, t)]).collect():
            found.setdefault(row["move"], {})[row["bin"]] = (row["value"], row["cnt"])
        assert [found[0], found[1]] == want


def test_refinement_by_links_keeps_them(spark):
    p = cloud(spark, 30, 5)
    ends = {r["body"]: r["id"] for r in p.groupBy("body").agg(F.min("id").alias("id")).collect()}
    at = {r["id"]: np.array([r["x"], r["y"], r["z"]]) for r in p.collect()}
    rest = float(np.linalg.norm(at[ends[0]] - at[ends[1]]))
    wanted = spark.createDataFrame([(ends[0], ends[1], rest, "bond")], "id_a long, id_b long, rest double, kind string")
    out = rigid.refine(p, profile_fit.simulate(p, 20), wanted, rounds=1, tries=2, select="link", sequential=True, mask="rotation")
    assert out.history == sorted(out.history, reverse=True) and out.history[0] < 1e-9
    with pytest.raises(ValueError):
        rigid.refine(p, p, select="link", rounds=1)


def test_scan_is_given_up(spark):
    def rows(values):
        return spark.createDataFrame([(0, float(len(values) - i), v) for i, v in enumerate(values)], "set_id int, p double, chi2 double")

    bad = [5.0, 1.0] + [3.0] * 8
    assert fitting.until_hopeless(rows(bad), ["set_id"], 2.0).count() == 10 and fitting.until_hopeless(rows(bad + [3.0] * 4), ["set_id"], 2.0).count() == 12
    assert fitting.until_hopeless(rows([1.0] * 12), ["set_id"], 2.0).count() == 12
    assert fitting.until_hopeless(rows(bad + [3.0] * 4), ["set_id"], 2.9, relative=False).count() == 12


def test_minima_of_a_scan():
    assert map_fit.smoothed_minima([(1, 5.0), (2, 4.0), (3, 9.0), (4, 1.0), (5, 9.0), (6, 8.0)], 1) == [2, 4, 6]
    assert map_fit.smoothed_minima([(k, abs(k - 4.0)) for k in range(1, 9)]) == [4]
    assert map_fit.smoothed_minima([]) == []


def test_cutoff_is_searched(spark):
    r = np.random.default_rng(6)
    v = spark.createDataFrame([(int(x), int(y), int(z), float(r.uniform(0, 10))) for x, y, z in np.ndindex(5, 5, 4)], "x int, y int, z int, val double").cache()
    truth = map_fit.banded_points(v, 4, 6.0, 10.0)
    found = map_fit.search_cutoff(v, profile_fit.simulate(truth, 20), 2.0, 10.0, levels=8, rounds=1, most=1)
    assert found.low <= found.cutoff <= found.high and found.chi2 < 1e-6
    assert v.where((F.col("val") >= found.cutoff) != (F.col("val") >= 6.0)).count() == 0


def test_image_landscape_and_dump(spark, tmp_path):
    v = spark.createDataFrame([(0, 0, 1, 2.0), (1, 1, 1, 4.0), (2, 0, 1, 5.0), (0, 0, 2, 9.0)], "x int, y int, z int, val double")
    assert {(r["x"], r["y"]): r["val"] for r in density_map.image(v, 1, 2).collect()} == {(0, 0): 3.0, (1, 0): 5.0}
    scan = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 1.0, 4.0), (2.0, 1.0, 6.0)], "p1 double, p2 double, chi2 double")
    sinks.write_landscape(scan, str(tmp_path / "l"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect())
    assert [[float(x) for x in line.split("\t")] for line in lines] == [[1.0, 4.0, 5.0], [2.0, 6.0]]
    marked = spark.createDataFrame([(0, 0, 0, True), (1, 0, 0, False)], "i long, j long, k long, surface boolean")
    sinks.write_pdb(sinks.voxel_atoms(marked, (1.0, 1.0, 1.0)), str(tmp_path / "g"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert len(text) == 2 and all(t.startswith("ATOM") for t in text) and {t[21] for t in text} == {"A", "B"}
