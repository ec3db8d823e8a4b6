"""Histograms of symmetric assemblies by delta, against all copies joined with each other."""

import numpy as np
import pytest

from pointmill.operators.symmetry import group
from pointmill.streaming import symmetric

POINTS = "body long, id long, x double, y double, z double, w double"


def state(seed, sizes):
    r = np.random.default_rng(seed)
    return [(b, 1000 * b + i, *map(float, r.uniform(-6, 6, 3)), float(r.integers(1, 4))) for b, n in sizes.items() for i in range(n)]


def brute(rows, members):
    """bin -> value, count of the assembly with every copy made."""
    made = []
    for g in {m[0] for m in members}:
        bodies, kind = [m[1] for m in members if m[0] == g], next(m[2] for m in members if m[0] == g)
        own = np.array([r[2:] for r in rows if r[0] in bodies])
        if not len(own):
            continue
        centre = (own[:, :3] * own[:, 3:]).sum(axis=0) / own[:, 3].sum()
        for turn in [np.eye(3)] if kind == "c1" else group(kind):
            made += [(*(turn @ (v[:3] - centre) + centre), v[3]) for v in own]
    made = np.array(made)
    d = np.sqrt(((made[:, None, :3] - made[None, :, :3]) ** 2).sum(axis=2))
    bins, w = np.floor(d / 0.25 + 0.5).astype(int).ravel(), np.outer(made[:, 3], made[:, 3]).ravel()
    return {int(b): (float(w[bins == b].sum()), int((bins == b).sum())) for b in np.unique(bins)}


def found(histogram):
    return {r["bin"]: (r["value"], r["cnt"]) for r in histogram.collect()}


def near(a, b):
    """Equal but for pairs at the edge of a bin."""
    off = sum(abs(a.get(k, (0, 0))[1] - b.get(k, (0, 0))[1]) for k in a.keys() | b.keys())
    assert sum(v[1] for v in a.values()) == sum(v[1] for v in b.values()) and sum(v[0] for v in a.values()) == sum(v[0] for v in b.values())
    return off <= 8


SIZES = {1: 12, 2: 9, 3: 7, 4: 5}
MEMBERS = [(10, 1, "c3"), (10, 2, "c3"), (3, 3, "d2"), (4, 4, "c1")]


@pytest.fixture
def tables(spark):
    return lambda rows, members: (spark.createDataFrame(rows, POINTS), spark.createDataFrame(members, "group long, body long, kind string"))


def test_the_schedule_is_the_whole_assembly(spark, tables, monkeypatch):
    monkeypatch.setattr(symmetric, "TILE", 4)
    rows = state(1, SIZES)
    points, members = tables(rows, MEMBERS)
    planned = symmetric.schedule(members)
    copies = {1: 3, 2: 3, 3: 4, 4: 1}
    assert planned.count() < sum(copies.values()) ** 2 / 2
    assert near(found(symmetric.assembly(symmetric.by_copy_pairs(points, members, planned), members)), brute(rows, MEMBERS))


@pytest.mark.parametrize("moved,kinds,dropped", [([1], {}, False), ([4], {}, False), ([], {3: "c2"}, False), ([3], {10: "c4"}, False), ([], {}, False), ([2], {}, True)])
def test_deltas(spark, tables, moved, kinds, dropped):
    rows = state(2, SIZES)
    new_rows = [(r[0], r[1], r[2] + 2.0, *r[3:]) if r[0] in moved else r for r in rows if not (dropped and r[0] in moved)]
    new_members = [(g, b, kinds.get(g, k)) for g, b, k in MEMBERS]
    points, members = tables(rows, MEMBERS)
    now, new = tables(new_rows, new_members)
    partial = symmetric.by_copy_pairs(points, members, symmetric.schedule(members)).cache()
    bodies, groups = spark.createDataFrame([(b,) for b in moved], "body long"), spark.createDataFrame([(g,) for g in kinds], "group long")
    after = symmetric.update(partial, now, new, bodies, groups).cache()
    assert near(found(symmetric.assembly(after, new)), brute(new_rows, new_members))
    # pairs without a moved copy are taken over as they are
    dirty = {tuple(r) for r in symmetric.dirty_copies(new, bodies, groups).collect()}
    groups_of = {b: g for g, b, _ in new_members}
    hit = {groups_of[b] for b in moved} | set(kinds)
    assert dirty == {(b, 0) for b in moved} | {(b, c) for g, b, k in new_members if g in hit for c in range(1, len(group(k)) if k != "c1" else 1)}
    clean = [r for r in after.collect() if (r["body_a"], r["copy_a"]) not in dirty and (r["body_b"], r["copy_b"]) not in dirty]
    old = {tuple(r) for r in partial.collect()}
    assert clean and all(tuple(r) in old for r in clean)
    if not moved and not kinds:
        assert {tuple(r) for r in after.collect()} == old


def test_shared_centre(spark, tables):
    rows = [(1, 0, 0.0, 0.0, 0.0, 1.0), (2, 1, 4.0, 2.0, 0.0, 3.0)]
    points, members = tables(rows, [(9, 1, "c2"), (9, 2, "c2")])
    table = {(r["body"], r["copy"]): r for r in symmetric.shared_transforms(points, members).collect()}
    assert len(table) == 4
    one = table[1, 1]
    assert np.allclose([one["t0"], one["t1"], one["t2"]], [6.0, 3.0, 0.0])  # 0 turned by half about (3, 1.5)
    assert symmetric.by_copy_pairs(points.where("false"), members, symmetric.schedule(members)).count() == 0
