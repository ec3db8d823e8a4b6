"""Distances of tiles: more points than a broadcast takes, points of one place, many kinds, exact sums without a bound."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointmill.operators import excluded_volume, pairs, profiles, tiles


def brute(p, width):
    found = {}
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            d = float(np.sqrt(((p.loc[i, ["x", "y", "z"]].astype(float) - p.loc[j, ["x", "y", "z"]].astype(float)) ** 2).sum()))
            a, b = sorted((p.g[i], p.g[j]))
            n = found.setdefault((a, b, int(np.floor(d / width + 0.5))), np.zeros(3))
            n += [p.w[i] * p.w[j], p.n[i] * p.n[j], d * p.n[i] * p.n[j]]
    return found


@pytest.mark.parametrize(("kinds", "counters"), [(64, 1 << 22), (1, 1 << 22), (64, 1)])
def test_a_tile_with_itself_equals_all_pairs(monkeypatch, kinds, counters):
    monkeypatch.setattr(tiles, "KINDS", kinds)
    monkeypatch.setattr(tiles, "COUNTERS", counters)
    monkeypatch.setattr(tiles, "BLOCK", 64)
    r = np.random.default_rng(1)
    p = pd.DataFrame({**{c: r.uniform(-3, 3, 25) for c in "xyz"}, "g": r.integers(0, 3, 25), "w": r.integers(1, 4, 25).astype(float), "n": r.integers(1, 3, 25)})
    found = tiles.histogram(p, None, ["g"], 0.5)
    want = brute(p, 0.5)
    assert len(found) == len(want)
    for row in found.itertuples():
        assert np.allclose([row.wsum, row.n, row.dist], want[row.g_a, row.g_b, row.bin])


@pytest.mark.parametrize("most", [4096, 0])
def test_points_of_one_place_are_pairs_too(spark, monkeypatch, most):
    """Voxels repeated have equal ids, and are still each other's pairs, as in SQL that numbers the rows."""
    monkeypatch.setattr(pairs, "BROADCAST_POINTS", most)
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0), (1, 0.0, 0.0, 0.0, 3.0), (2, 3.0, 4.0, 0.0, 1.0)], "id long, x double, y double, z double, w double")
    assert {r["bin"]: (r["value"], r["cnt"], r["dsum"]) for r in pairs.pair_histogram(p).collect()} == {0: (26.0, 5, 0.0), 20: (10.0, 4, 20.0)}


def test_exact_sums_of_many_points(spark, monkeypatch):
    monkeypatch.setattr(profiles, "EXACT_POINTS", 3)
    p = spark.range(50).select("id", *[((F.col("id") * k) % 7).cast("double").alias(c) for k, c in ((3, "x"), (5, "y"), (11, "z"))], F.lit(2.0).alias("w"))
    at = np.array([[r["x"], r["y"], r["z"]] for r in p.collect()])
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    q = spark.createDataFrame([(0.3,), (1e-5,)], "q double")
    for r in profiles.exact(p, q, bounded=False).collect():
        assert abs(r["intensity"] - 4 * np.sinc(r["q"] * d / np.pi).sum()) < 1e-6


def test_displaced_terms_read_the_pairs_once(spark):
    h = spark.createDataFrame([(0, 0, 1, 4.0), (0, 1, 1, 6.0)], "ff_a long, ff_b long, bin long, value double")
    made = excluded_volume.histograms(h.withColumn("bin", F.udf(lambda b: b, "long")("bin")))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("BatchEvalPython") == 1
    rows = {(r["term"], r["ff_a"], r["ff_b"]): r["value"] for r in made.collect()}
    assert rows == {("aa", 0, 0): 4.0, ("aa", 0, 1): 6.0, ("ax", 0, 0): 4.0, ("ax", 0, 1): 3.0, ("ax", 1, 0): 3.0, ("xx", 0, 0): 4.0, ("xx", 0, 1): 6.0}


@pytest.mark.parametrize("name", ["side", "i", "own"])
def test_groups_may_have_any_name(spark, monkeypatch, name):
    """Waters of a map are grouped by a column side, which tiles had a column of too."""
    p = spark.range(30).select("id", *[((F.col("id") * k) % 7).cast("double").alias(c) for k, c in ((3, "x"), (5, "y"), (11, "z"))], F.lit(1.0).alias("w"), (F.col("id") % 2).alias(name))
    want = sorted(pairs.cross_histogram(p, p, [name]).collect())
    monkeypatch.setattr(pairs, "BROADCAST_POINTS", 0)
    assert [r[:5] for r in sorted(pairs.cross_histogram(p, p, [name]).collect())] == [r[:5] for r in want]


@pytest.mark.parametrize("width", [0.25, 0.3])
def test_blocks_hold_rows_of_one_kind(width):
    """Rows are sorted by kind, and no block goes on over the rows of another; bins are those of the distances as they are."""
    r = np.random.default_rng(2)
    p = pd.DataFrame({**{c: r.integers(-8, 8, 60) * 0.125 for c in "xyz"}, "g": r.integers(0, 4, 60), "w": 1.0, "n": 1})
    ends = np.flatnonzero(np.diff(np.sort(p.g))) + 1
    own = np.sort(p.g.to_numpy())
    seen = 0
    for rows, _, d, _, out in tiles.blocks(p, None, 1000, ends.tolist(), 4.0):
        assert len(set(own[rows])) == 1
        seen += d.size - out.sum()
    assert seen == 60 * 59 // 2
    found = {(x.g_a, x.g_b, x.bin): [x.wsum, x.n, x.dist] for x in tiles.histogram(p, None, ["g"], width).itertuples()}
    want = brute(p, width)
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in want)


def _lattice(spark, n):
    at = ((F.col("id") % 17, "x"), (F.floor(F.col("id") / 17), "y"), (F.col("id") * 7 % 13, "z"))
    return spark.range(n).select("id", *[v.cast("double").alias(c) for v, c in at], (F.col("id") % 3 + 1).cast("double").alias("w"), (F.col("id") % 2).alias("g"))


@pytest.mark.parametrize("own", [True, False])
def test_tasks_hold_equal_numbers_of_pairs_of_tiles(spark, own):
    """Pairs of tiles are numbered and dealt out in turn; by a hash some tasks had several times the pairs of others."""
    p = _lattice(spark, 600)
    dealt = tiles.tasks(p, None if own else p, [], ["x", "y", "z", "w"], 40)
    rows = dealt.select(F.spark_partition_id().alias("part"), "__i", "__j", "__side", F.size("__rows").alias("n")).collect()
    pairs_of = {}
    for r in rows:
        pairs_of.setdefault(r["part"], set()).add((r["__i"], r["__j"]))
    count = [len(v) for v in pairs_of.values()]
    assert sum(count) == (15 * 16 // 2 if own else 15 * 15) and max(count) - min(count) <= 1
    assert len(rows) == (15 * 15 if own else 2 * 15 * 15) and sum(r["n"] for r in rows) == (600 * 15 if own else 2 * 600 * 15)


@pytest.mark.parametrize("group", [[], ["g"]])
def test_many_tiles_equal_the_join(spark, monkeypatch, group):
    """Of a set with itself, of two sets, within and between groups: pairs of tiles follow each other in a task."""
    p, q = _lattice(spark, 130), _lattice(spark, 90).withColumn("x", F.col("x") + 0.5)

    def both():
        found = pairs.pair_histogram(p, group), pairs.cross_histogram(p, q, group)
        return [sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in h.collect()) for h in found]

    want = both()
    monkeypatch.setattr(pairs, "BROADCAST_POINTS", 0)
    monkeypatch.setattr(pairs, "TILE", 20)
    assert both() == want
    parts = [p.where(F.col("g") == k) for k in (0, 1)], [q.where(F.col("g") == k) for k in (0, 1)]
    for k in (0, 1):
        for found, one in ((pairs.within_histogram(p, ["g"], tile=20), pairs.pair_histogram(parts[0][k])), (pairs.between_histogram(p, q, ["g"], tile=20), pairs.cross_histogram(parts[0][k], parts[1][k]))):
            got = {r["bin"]: (r["value"], r["cnt"]) for r in found.where(F.col("g") == k).collect()}
            assert got == {r["bin"]: (r["value"], r["cnt"]) for r in one.collect()}


def test_a_block_takes_twenty_bytes_a_distance(monkeypatch):
    """Distances, shifted ones or counters' numbers in their place, and numbers of four bytes; they were 24."""
    monkeypatch.setattr(tiles, "BLOCK", 1 << 20)
    r = np.random.default_rng(3)
    a, b = (pd.DataFrame({**{c: r.uniform(-2, 2, 1024) for c in "xyz"}, "w": 1.0, "n": 1}) for _ in range(2))
    tiles.histogram(a, b, [], 0.25)
    tracemalloc.start()
    found = tiles.histogram(a, b, [], 0.25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.n.sum() == 1 << 20 and peak < 22 << 20


@pytest.mark.parametrize("far", [1e3, 1e8, 1e9])
def test_bins_beyond_four_bytes(far):
    """Counters' numbers have eight bytes where four don't hold them."""
    p = pd.DataFrame({"x": [0.0, far, far + 1, 3.0], "y": 0.0, "z": 0.0, "w": [1.0, 2.0, 3.0, 4.0], "n": 1})
    found = tiles.histogram(p, None, [], 0.25)
    want = brute(p.assign(g=0), 0.25)
    assert {k[2]: tuple(v) for k, v in want.items()} == {x.bin: (x.wsum, x.n, x.dist) for x in found.itertuples()}


def test_counters_of_a_large_span_are_bounded(monkeypatch):
    """Beyond the counters that a task may hold, found bins are summed as they come, not kept block by block."""
    monkeypatch.setattr(tiles, "COUNTERS", 64)
    monkeypatch.setattr(tiles, "BLOCK", 1 << 10)
    most = [0]
    real = pd.concat

    def concat(parts, *a, **k):
        parts = list(parts)
        if "key" in parts[0]:
            most[0] = max(most[0], sum(map(len, parts)))
        return real(parts, *a, **k)

    monkeypatch.setattr(pd, "concat", concat)
    r = np.random.default_rng(3)
    p = pd.DataFrame({**{c: r.uniform(0, 30, 1_200) for c in "xyz"}, "w": 1.0, "n": 1, "band": r.integers(1, 5, 1_200)})
    found = tiles.histogram(p, None, ["band"], 0.25)
    assert found["n"].sum() == 1_200 * 1_199 / 2
    assert most[0] < 20_000


@pytest.mark.parametrize("extent", [0.0, 3.0, 40.0])
def test_exact_sums_by_directions_equal_all_pairs(spark, monkeypatch, extent):
    """Beyond the points that go by pairs, the same sums come without pairs of tiles."""
    r = np.random.default_rng(5)
    p = pd.DataFrame({c: r.uniform(-1, 1, 3_000) * extent + 7 for c in "xyz"}).assign(z=lambda x: x["z"] + 1e-3 * r.uniform(size=3_000), w=r.choice([1.0, 2.5, -0.5], 3_000))
    q = [0.0, 1e-4, 0.05, 0.3, 0.5]
    asked, points = spark.createDataFrame([(v,) for v in q], "q double"), spark.createDataFrame(p)
    pairs_ = {v["q"]: v["intensity"] for v in profiles.exact(points, asked, bounded=False).collect()}
    monkeypatch.setattr(profiles, "EXACT_POINTS", 100)

    def tasks(*_, **__):
        raise AssertionError("pairs of tiles")

    monkeypatch.setattr(tiles, "tasks", tasks)
    found = {v["q"]: v["intensity"] for v in profiles.exact(points, asked, bounded=False).collect()}
    assert set(found) == set(q)
    scale = (p["w"] ** 2).sum()
    assert all(found[v] == pytest.approx(pairs_[v], rel=1e-11, abs=1e-10 * scale) for v in q)


def test_too_many_directions_go_by_pairs():
    assert profiles._directions([0.5], 1e5) is None and profiles._directions([0.5], float("nan")) is None
    assert profiles._directions([0.5], 10.0).shape[1] < 1_000
    assert profiles._directions([0.05, 0.5], 10.0)[4].sum() == pytest.approx(2.0, rel=1e-13)
