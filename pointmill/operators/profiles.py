"""Kernel transforms: from a distance histogram to intensity over q.

A q axis is small whatever the data (hundreds of samples), so it is broadcast to the histogram, which stays dealt out
however many categories it is kept by; sums are formed where the bins are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.config import Q_AXIS, Q_RANGE, Axis
from pointmill.operators.pairs import weighted_axis
from pointmill.stored import stored


def q_axis(spark: SparkSession, axis: Axis = Q_AXIS, low: float = Q_RANGE[0], high: float = Q_RANGE[1]) -> DataFrame:
    """q of the samples of the axis in [low, high)."""
    q = F.lit(axis.low) + F.col("id") * F.lit(axis.width)
    return spark.range(axis.bins).select(q.alias("q")).where((F.col("q") >= low - 1e-12) & (F.col("q") < high - 1e-12))


def sinc(x: Column) -> Column:
    """sin(x) / x, by its series near 0."""
    return F.when(x < 1e-3, 1 - x * x / 6 + x * x * x * x / 120).otherwise(F.sin(x) / x)


def envelope(q: Column) -> Column:
    return F.exp(-q * q)


def debye_waller(q: Column, sigma: float, ends: Column | int = 1) -> Column:
    """exp(-q^2 sigma^2 / 2) for each end of a pair that moves."""
    return F.pow(F.exp(-q * q * (sigma * sigma / 2)), ends if isinstance(ends, Column) else F.lit(ends))


def transform(histogram: DataFrame, q: DataFrame, keys: list[str] | None = None, enveloped: bool = True) -> DataFrame:
    """q, [keys,] intensity = sum of value * sinc(q d), d being each bin's mean distance."""
    keys = keys or []
    placed = weighted_axis(histogram).where("value <> 0").select(*keys, "value", "d")
    joined = placed.join(F.broadcast(q))
    term = F.col("value") * sinc(F.col("q") * F.col("d"))
    out = joined.groupBy("q", *keys).agg(F.sum(term).alias("intensity"))
    return out.withColumn("intensity", F.col("intensity") * envelope(F.col("q"))) if enveloped else out


def transform_at(histogram: DataFrame, q: DataFrame, axis: Axis = Q_AXIS, low: float = Q_RANGE[0], high: float = Q_RANGE[1]) -> DataFrame:
    """q, intensity at any q (a small table): inside the default axis by the spline through its samples, which are computed
    once whatever is asked; outside by the kernel itself."""
    from pointmill.operators.spline import interpolate_at
    from pointmill.ordered import number_rows

    spark, asked, histogram = histogram.sparkSession, q.select("q").distinct(), stored(histogram)  # a row a bin, read by both
    last = max(axis.value(i) for i in range(axis.bins) if axis.value(i) < high - 1e-12)
    inside = F.col("q").between(low - 1e-12, last + 1e-12)
    knots = transform(histogram, q_axis(spark, axis, low, high)).select(F.lit(0).alias("set_id"), F.col("q").alias("x"), F.col("intensity").alias("y"))
    near = interpolate_at(number_rows(knots, ["set_id"], ["x"], F.lit(0)), asked.where(inside).select(F.lit(0).alias("set_id"), F.col("q").alias("x")))
    return near.select(F.col("x").alias("q"), F.col("y").alias("intensity")).unionByName(transform(histogram, asked.where(~inside)))


#: Points that exact() takes at most, unless told to take all: it goes through every pair times every q.
EXACT_POINTS = 20_000
#: Beyond those, directions of all q at most, the share of a sum that may be missing (below rounding), and points of a block.
DIRECTIONS, REST, ROWS = 50_000, 1e-17, 2048


def _degree(x: float) -> int:
    """The least even degree beyond which the plane wave's terms (2l + 1) j_l(x) are less than REST together. They are at most
    x^l / (2l - 1)!!, falling by more than half each from there on."""
    term, l = 1.0, 0
    while term > REST / 4 or 2 * l + 1 < 2 * x or l % 2:
        l += 1
        term *= x / (2 * l - 1)
    return l


def _directions(q: list[float], diameter: float) -> np.ndarray | None:
    """q's number, x, y, z (times q) and weight of the directions over half a sphere by which the mean of |F|^2 is exact up to
    each q's degree: Gauss nodes along the axis times even steps about it. None if those are too many."""
    if not math.isfinite(diameter) or (max(q, default=0.0) * diameter) ** 2 > 4 * DIRECTIONS:  # there are more than a quarter of the square
        return None
    out, total = [], 0
    for k, v in enumerate(q):
        degree = _degree(v * diameter)
        nodes, steps = 2 * (degree // 4 + 1), degree + 2
        total += nodes // 2 * steps
        if total > DIRECTIONS:
            return None
        u, weight = np.polynomial.legendre.leggauss(nodes)
        u, weight = (x[u > 0].repeat(steps) for x in (u, weight))
        turn = np.tile(2 * pi * np.arange(steps) / steps, nodes // 2)
        flat = np.sqrt(1 - u * u)
        out.append(np.stack([np.full(len(u), float(k)), v * flat * np.cos(turn), v * flat * np.sin(turn), v * u, weight / steps]))
    return np.concatenate(out, axis=1) if out else None


def _by_directions(places: DataFrame, asked: list[float], ways: np.ndarray, centre: list[float]) -> DataFrame:
    """q, intensity: sum of wa wb sinc(q d) over all pairs is the mean of |sum w exp(i q s r)|^2 over all directions s."""

    def waves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, ways.shape[1]))
        for batch in batches:
            at, w = batch[["x", "y", "z"]].to_numpy(np.float64) - centre, batch["w"].to_numpy(np.float64)
            for lo in range(0, len(at), ROWS):
                for first in range(0, ways.shape[1], 64):  # a block stays in the cache
                    phase = at[lo : lo + ROWS] @ ways[1:4, first : first + 64]
                    total[0, first : first + 64] += w[lo : lo + ROWS] @ np.cos(phase)
                    total[1, first : first + 64] += w[lo : lo + ROWS] @ np.sin(phase)
        yield pd.DataFrame({"way": np.arange(ways.shape[1]), "re": total[0], "im": total[1]})

    summed = places.mapInPandas(waves, "way long, re double, im double").groupBy("way").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    names = pd.DataFrame({"way": np.arange(ways.shape[1]), "q": np.asarray(asked)[ways[0].astype(int)], "weight": ways[4]})
    table = places.sparkSession.createDataFrame(names)  # at most DIRECTIONS rows
    return summed.join(F.broadcast(table), "way").groupBy("q").agg(F.sum(F.col("weight") * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("intensity"))


def exact(points: DataFrame, q: DataFrame, bounded: bool = True) -> DataFrame:
    """All pairs times all q (a small table), without bins, to check the others by. If bounded, more than EXACT_POINTS are
    refused; up to those, pairs are gone through by tiles, as in pair_histogram, and only a sum for each q leaves a task.

    Beyond, the same sum over all pairs is taken as the mean over directions of the squared sum over points, which is equal and
    goes through each point once for each direction. Directions are so many that what is missing is below rounding; they
    grow with the square of q times the points' extent, and where they are too many, pairs are gone through."""
    from pointmill.operators import tiles
    from pointmill.operators.pairs import TILE

    if bounded:
        n = points.count()
        if n > EXACT_POINTS:
            raise ValueError(f"{n} points are too many for the exact transform (at most {EXACT_POINTS}): use pair_histogram and transform")
    places = points.groupBy(*[F.col(c).cast("double").alias(c) for c in "xyz"]).agg(F.sum("w").cast("double").alias("w"))
    asked = [float(r["q"]) for r in q.select("q").distinct().collect()]
    if not bounded:
        box = places.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("x + y + z + w").isNull()).alias("empty"), *[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
        if box["n"] > EXACT_POINTS and not box["empty"] and min(asked, default=-1.0) >= 0:
            ends = [(box[f"{c}_lo"], box[f"{c}_hi"]) for c in "xyz"]
            ways = _directions(asked, math.dist(*zip(*ends, strict=True)))
            if ways is not None and 2 * ways.shape[1] < box["n"] * len(asked):
                return _by_directions(places, asked, ways, [(lo + hi) / 2 for lo, hi in ends])
    own = places.agg(F.sum(F.col("w") * F.col("w")).alias("own"))

    def sums(left: pd.DataFrame, right: pd.DataFrame | None) -> pd.DataFrame:
        return tiles.sinc_sums(left, right, asked)

    found = tiles.each(tiles.tasks(places, None, [], [*"xyz", "w"], TILE), [], True, sums, "q double, part double")
    total = found.groupBy("q").agg(F.sum("part").alias("part"))
    start = points.sparkSession.createDataFrame([(v,) for v in asked], "q double").join(F.broadcast(own)).where("own IS NOT NULL")
    return start.join(total, "q", "left").select("q", (F.col("own") + 2 * F.coalesce("part", F.lit(0.0))).alias("intensity"))


def combined(profiles: DataFrame, signs: dict[str, float]) -> DataFrame:
    """Sum over kinds with a sign each, such as aa - ax + aw + xx - wx + ww."""
    table = F.create_map(*[x for k, s in signs.items() for x in (F.lit(k), F.lit(float(s)))])
    return profiles.groupBy("q").agg(F.sum(F.col("intensity") * F.coalesce(table[F.col("kind")], F.lit(0.0))).alias("intensity"))


def form_factor(q: Column, a: list[float], b: list[float], c: float, q0: float = 1.0) -> Column:
    """A sum of Gaussians and a constant: (sum a exp(-b q^2) + c) q0."""
    total = F.lit(c)
    for x, y in zip(a, b, strict=True):
        total = total + x * F.exp(-y * q * q)
    return total * q0


def volume_form_factor(q: Column, volume: Column | float, density: float) -> Column:
    """density V exp(-V^(2/3) / (4 pi) q^2): of displaced water."""
    v = volume if isinstance(volume, Column) else F.lit(volume)
    return density * v * F.exp(-F.pow(v, F.lit(2 / 3)) / (4 * pi) * q * q)


def volume_scale(q: Column, cx: float, kind: str = "average", c: float = 0.0) -> Column:
    """How displaced volume scales with cx: cx^3 exp(-c (cx^2 - 1) q^2) for explicit models with their own c, cx for
    averages and grids, 1 where coordinates scale, 1 + cx (3 - c) for the linearised one."""
    if kind == "explicit":
        return cx**3 * F.exp(-c * (cx * cx - 1) * q * q)
    return F.lit({"average": cx, "grid": cx, "scalable": 1.0, "linear": 1 + cx * (3 - c)}[kind])


#: Mean radii in Angstrom that other programs for the same curves scale displaced volume by.
GAUSSIAN_RADIUS, LINEAR_RADIUS = 1.58, 1.64


def emulated_scale(q: Column, cx: float, program: str, mean_volume: float | None = None) -> Column:
    """How three other published conventions scale displaced volume with cx: "volume", by the mean displaced volume (needed
    there alone; doi 10.1107/S0021889895007047), "radius", by a fixed mean radius, both as explicit models, and "linear", by
    a constant radius without q (doi 10.1107/S2059798317005745)."""
    if program == "volume":
        if mean_volume is None:
            raise ValueError("the mean displaced volume is needed")
        return volume_scale(q, cx, "explicit", mean_volume ** (2 / 3) / (4 * pi))
    if program == "radius":
        return volume_scale(q, cx, "explicit", GAUSSIAN_RADIUS**2 / (4 * pi))
    if program == "linear":
        return volume_scale(q, cx, "linear", 2 * pi * (4 * pi / 3) ** (2 / 3) * LINEAR_RADIUS**2)
    raise ValueError(f"no program {program}")


def surface_total(interior: Column, cross: Column, surface: Column, cx: float) -> Column:
    """ii + cx is + cx^2 ss."""
    return interior + cx * cross + cx * cx * surface


def with_form_factors(profiles: DataFrame, factors: DataFrame, group: str = "ff") -> DataFrame:
    """q, intensity: profiles by pair of categories times both categories' factors (ff, q, f), a bounded dimension table."""
    one = F.broadcast(factors.select(F.col(group).alias(f"{group}_a"), "q", F.col("f").alias("__fa")))
    two = F.broadcast(factors.select(F.col(group).alias(f"{group}_b"), "q", F.col("f").alias("__fb")))
    return profiles.join(one, [f"{group}_a", "q"]).join(two, [f"{group}_b", "q"]).groupBy("q").agg(F.sum(F.col("intensity") * F.col("__fa") * F.col("__fb")).alias("intensity"))
