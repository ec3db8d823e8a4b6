"""Displaced volume on a grid: which filled voxels lie at the surface, seen along rays, and the terms that voxels add.

Voxels are rows (i, j, k). Rays are a table of a few directions; a filled voxel tells every voxel that looks at it along a
ray, so a surface is one aggregation over bit masks, whatever the size of the grid. Atoms and voxels are then one table of
points by category, and all terms of a profile come from one histogram by pair of categories.
"""

from __future__ import annotations

from math import cos, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.config import DISTANCE_AXIS, GridConfig
from pointmill.operators import pairs
from pointmill.operators.voxels import expand, strided

#: Categories of voxels in tables of points: of the interior, and of the surface.
INTERIOR, SURFACE = -1, -2
#: What a ray counts that is first stopped at its first, second and third step, or at none, and the sum from
#: which on a voxel lies at the surface.
STEP_SCORES, CLEAR_SCORE, SURFACE_SCORE = (0, 3, 5), 7, 42


def directions(divisions: int = 8) -> list[tuple[float, float, float]]:
    """Unit vectors to the crossings of a grid of latitudes and longitudes, divisions to a full turn (a multiple of 4)."""
    if divisions % 4:
        raise ValueError("divisions is a multiple of 4")

    def cosine(step: int) -> float:  # equal at mirrored steps, 0 and 1 where they should be
        step %= divisions
        step = min(step, divisions - step)
        return -cosine(divisions // 2 - step) if 4 * step > divisions else 0.0 if 4 * step == divisions else cos(2 * pi * step / divisions)

    def sine(step: int) -> float:
        return cosine(step - divisions // 4)

    poles = [(0.0, 0.0, 1.0), (0.0, 0.0, -1.0)]
    rings = range(1, divisions // 2)
    return poles + [(sine(t) * cosine(p), sine(t) * sine(p), cosine(t)) for t in rings for p in range(divisions)]


def ray_steps(cell: float = 1.0, divisions: int = 8) -> list[tuple[int, int, int, int, int]]:
    """(ray, step, i, j, k): the voxels, counted from the one that looks, that each ray meets at its three steps. A length is
    rounded (halves away from 0) before it is divided by the cell."""
    rays = np.array(directions(divisions))
    radii = np.array([sqrt(cell) + 1e-3, 2 * cell, 3 * cell])  # fixed values
    lengths = (rays[:, None, :] * radii[None, :, None]).round(9)
    voxels = np.trunc(np.trunc(lengths + np.copysign(0.5, lengths)) / cell).astype(int)
    return [(ray, step + 1, *map(int, voxels[ray, step])) for ray, step in np.ndindex(len(rays), len(radii))]


def ray_scores(voxels: DataFrame, cell: float = 1.0, divisions: int = 8) -> DataFrame:
    """i, j, k, score of each filled voxel: the sum over rays of what each counts. A filled voxel sends its neighbours one
    mask of rays for each step; masks are or-ed before and after the one shuffle."""
    steps = ray_steps(cell, divisions)
    rays = 1 + max(s[0] for s in steps)
    if rays > 63:
        raise ValueError("at most 63 rays")
    masks: dict[tuple[int, int, int], list[int]] = {(0, 0, 0): [0, 0, 0]}
    for ray, step, *at in steps:
        masks.setdefault(tuple(at), [0, 0, 0])[step - 1] |= 1 << ray
    offsets = F.array(*[F.struct(*[F.lit(-v).alias(n) for v, n in zip(at, "abc", strict=True)], *[F.lit(m).cast("long").alias(f"m{s}") for s, m in enumerate(own, 1)], F.lit(int(at == (0, 0, 0))).alias("self")) for at, own in masks.items()])
    filled = voxels.select("i", "j", "k").distinct()
    told = filled.withColumn("o", F.explode(offsets)).select(*[(F.col(n) + F.col(f"o.{m}")).alias(n) for n, m in zip("ijk", "abc", strict=True)], "o.m1", "o.m2", "o.m3", "o.self")
    seen = told.groupBy("i", "j", "k").agg(*[F.bit_or(m).alias(m) for m in ("m1", "m2", "m3")], F.max("self").alias("self")).where("self = 1")
    one, two, three = F.col("m1"), F.col("m2"), F.col("m3")
    stopped = one.bitwiseOR(two)
    first = [F.bit_count(one), F.bit_count(two.bitwiseAND(F.bitwise_not(one))), F.bit_count(three.bitwiseAND(F.bitwise_not(stopped)))]
    clear = F.lit(rays) - F.bit_count(stopped.bitwiseOR(three))
    score = sum((n * s for n, s in zip(first, STEP_SCORES, strict=True)), clear * CLEAR_SCORE)
    return seen.select("i", "j", "k", score.cast("long").alias("score"))


def surface_by_rays(voxels: DataFrame, cell: float = 1.0, thickness: float = 1.0, divisions: int = 8) -> DataFrame:
    """i, j, k, surface: whether enough rays leave a filled voxel, or such a one lies within half the thickness."""
    marked = ray_scores(voxels, cell, divisions).select("i", "j", "k", (F.col("score") >= SURFACE_SCORE).alias("surface"))
    reach = int(round(thickness / cell)) // 2
    if reach == 0:
        return marked
    grown = expand(marked.where("surface"), float(reach), 1.0).withColumn("__near", F.lit(True))
    return marked.join(grown, ["i", "j", "k"], "left").select("i", "j", "k", (F.col("surface") | F.coalesce("__near", F.lit(False))).alias("surface"))


def voxel_points(marked: DataFrame, low: tuple[float, float, float], cell: float = 1.0, width: float = GridConfig.exv_width, scale: float = 1.0, category: str = "ff") -> DataFrame:
    """id, x, y, z, w, ff: a point of weight 1 for each marked voxel that the stride of width meets, under its category. Ids
    are below 0 and tell all voxels within 2^20 of the origin apart; coordinates are taken times scale, for a volume that
    scales with them."""
    at = strided(marked, max(1, round(width / cell)))
    own = sum((F.shiftleft((F.col(n) + (1 << 20)).cast("long"), 42 - 21 * p) for p, n in enumerate("ijk")), F.lit(0).cast("long"))
    xyz = [((F.lit(lo) + F.col(n) * cell) * scale).alias(c) for lo, n, c in zip(low, "ijk", "xyz", strict=True)]
    return at.select((-1 - own).alias("id"), *xyz, F.lit(1.0).alias("w"), F.when(F.col("surface"), SURFACE).otherwise(INTERIOR).cast("long").alias(category))


def histograms(atoms: DataFrame, cells: DataFrame, width: float = DISTANCE_AXIS.width, category: str = "ff") -> DataFrame:
    """ff_a, ff_b, bin, value, cnt, dsum of atoms (categories from 0, ids from 0) and voxels together; each pair of
    categories has mean distances of its own."""
    columns = [*pairs.POINT, category]
    atoms = atoms.select(*columns).withColumn(category, F.col(category).cast("long"))
    return pairs.pair_histogram(atoms.unionByName(cells.select(*columns)), [category], width)


def terms(profiles: DataFrame, factors: DataFrame, category: str = "ff") -> DataFrame:
    """q, aa, ai, as, ii, is, ss: atoms (a), interior (i) and surface (s) with each other. profiles are by pair of categories;
    factors (ff, q, f) is the bounded table of all categories, those of voxels among them."""
    a, b = f"{category}_a", f"{category}_b"
    one = F.broadcast(factors.select(F.col(category).alias(a), "q", F.col("f").alias("__fa")))
    two = F.broadcast(factors.select(F.col(category).alias(b), "q", F.col("f").alias("__fb")))

    def kind(c: str):
        return F.when(F.col(c) == INTERIOR, "i").when(F.col(c) == SURFACE, "s").otherwise("a")

    joined = profiles.join(one, [a, "q"]).join(two, [b, "q"]).select("q", F.array_join(F.array_sort(F.array(kind(a), kind(b))), "").alias("kind"), (F.col("intensity") * F.col("__fa") * F.col("__fb")).alias("v"))
    return joined.groupBy("q").agg(*[F.sum(F.when(F.col("kind") == k, F.col("v")).otherwise(0.0)).alias(k) for k in ("aa", "ai", "as", "ii", "is", "ss")])


def profile(wide: DataFrame, scale: float = 1.0, surface: float = 1.0) -> DataFrame:
    """q, intensity = aa - k (ai + s as) + k^2 (ii + s is + s^2 ss): k scales all displaced volume, s that of the surface."""
    k, s = F.lit(float(scale)), F.lit(float(surface))
    own = F.col("ii") + s * F.col("is") + s * s * F.col("ss")
    return wide.select("q", (F.col("aa") - k * (F.col("ai") + s * F.col("as")) + k * k * own).alias("intensity"))


def weighted_counts(histogram: DataFrame, factors: DataFrame, category: str = "ff") -> DataFrame:
    """bin, value: counts by pair of categories times both categories' factors at q = 0 (ff, f)."""
    one = F.broadcast(factors.select(F.col(category).alias(f"{category}_a"), F.col("f").alias("__fa")))
    two = F.broadcast(factors.select(F.col(category).alias(f"{category}_b"), F.col("f").alias("__fb")))
    joined = histogram.join(one, f"{category}_a").join(two, f"{category}_b")
    return joined.groupBy("bin").agg(F.sum(F.col("value") * F.col("__fa") * F.col("__fb")).alias("value"))
