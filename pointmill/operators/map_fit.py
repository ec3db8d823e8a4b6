"""Fitting a density map's cutoff: which voxels, taken as points, give the measured curve.

Voxels are banded by density. A pair of voxels is above a cutoff if its lesser band is, so one join by lesser band serves
every cutoff: its histogram is the sum over the bands from there on. Many voxels on a lattice are counted by steps instead, at
each cutoff (operators/lattice.py).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.config import DISTANCE_AXIS
from pointmill.operators import density_map, lattice
from pointmill.operators.fitting import chi2, regression
from pointmill.operators.pairs import merge, pair_histogram
from pointmill.operators.profiles import q_axis, transform
from pointmill.operators.spline import splice
from pointmill.ordered import number_rows


def banded_points(voxels: DataFrame, levels: int, low: float, high: float, cell: float = 1.0) -> DataFrame:
    """Voxels of at least low as points of weight 1, with their band (from 1)."""
    own = density_map.bands(density_map.above(voxels, low), levels, low, high)
    return own.select(F.xxhash64("x", "y", "z").alias("id"), *[(F.col(c) * cell).cast("double").alias(c) for c in "xyz"], F.lit(1.0).alias("w"), "band")


def at_levels(points: DataFrame, levels: int) -> DataFrame:
    """points with a row for each level whose shape they belong to."""
    return points.withColumn("level", F.explode(F.sequence(F.lit(1), F.least(F.col("band"), F.lit(levels)))))


def cutoff_histograms(points: DataFrame, levels: int, width: float = DISTANCE_AXIS.width) -> DataFrame:
    """level, bin, value, cnt, dsum for the cutoff at the foot of each band from 1 to levels."""
    if (found := lattice.histograms(at_levels(points, levels), ["level"], [], width)) is not None:
        return found
    by_band = merge(pair_histogram(points, ["band"], width).withColumnRenamed("band_a", "band").drop("band_b"), ["band"])
    every = F.explode(F.sequence(F.lit(1), F.least(F.col("band"), F.lit(levels))))
    return merge(by_band.withColumn("level", every).drop("band"), ["level"])


def fit_cutoff(points: DataFrame, data: DataFrame, levels: int) -> DataFrame:
    """level, chi2, a, b: the measured curve against the profile of each cutoff."""
    return _fit_cutoff(points, data, levels)[0]


def _fit_cutoff(points: DataFrame, data: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """The fits, and the cached profiles that they are read from: hundreds of rows a level."""
    spark = points.sparkSession
    models = transform(cutoff_histograms(points, levels), q_axis(spark), ["level"]).select(F.col("level").alias("set_id"), F.col("q").alias("x"), F.col("intensity").alias("y")).persist()  # few rows, read more than once
    curves = number_rows(models, ["set_id"], ["x"], F.lit(0))
    measured = data.drop("set_id").withColumn("set_id", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    joined = splice(curves, measured)
    line = regression(joined, ["set_id"], x="model")
    fits = line.join(chi2(joined, line, ["set_id"], x="model"), "set_id").select(F.col("set_id").alias("level"), "chi2", "a", "b")
    return fits, models


@dataclass
class Cutoff:
    """The best cutoff, its chi2, the least and greatest cutoff whose chi2 lies within the allowance, the cutoffs at whose
    minima the coarse, smoothed scan was looked at closer, and the best one's mass and factor of the waters' weight (of a fit
    with waters)."""

    cutoff: float
    chi2: float
    low: float
    high: float
    minima: list[float] = field(default_factory=list)
    mass: float = 0.0
    water: float | None = None


def smoothed_minima(scan: list[tuple[int, float]], window: int = 3) -> list[int]:
    """The levels at which chi2, averaged over neighbours, is lower than on both sides; an end counts if it is the lower one.
    scan holds a row for each level."""
    rows = sorted(scan)
    half = window // 2
    smooth = [sum(c for _, c in rows[max(0, i - half) : i + half + 1]) / len(rows[max(0, i - half) : i + half + 1]) for i in range(len(rows))]
    inside = [float("inf"), *smooth, float("inf")]
    return [rows[i][0] for i in range(len(rows)) if inside[i] > inside[i + 1] < inside[i + 2]]


def search_cutoff(voxels: DataFrame, data: DataFrame, low: float, high: float, levels: int = 16, cell: float = 1.0, rounds: int = 2, most: int = 3, allowance: float = 0.1, hydrate: bool = False, density: float = 0.81) -> Cutoff:
    """The cutoff whose voxels give the measured curve: a coarse scan over low..high, then closer scans about each of the
    best minima of its smoothed chi2, and about the best of those again. A scan of all its levels is one job; the driver sees
    a row for each level. With hydrate, waters are placed about the shape of every level, and the factor of their weight is
    fitted with it."""
    from pointmill.operators.map_water import fit_cutoffs, masses

    seen: dict[float, float] = {}
    factors: dict[float, float] = {}
    weights: dict[float, float] = {}
    data = data.persist()  # few rows, read by every scan

    def scan(lo: float, hi: float) -> list[tuple[int, float]]:
        step = (hi - lo) / levels
        points = banded_points(voxels, levels, lo, hi, cell)
        weights.update({lo + (r["level"] - 1) * step: r["mass"] for r in masses(points, levels, lo, hi, cell, density).collect()})  # a row a level
        if hydrate:
            found = [tuple(r) for r in fit_cutoffs(points, data, levels).select("level", "chi2", "water").collect()]
            rows = [(k, c) for k, c, _ in found]
            factors.update({lo + (k - 1) * step: f for k, _, f in found})
        else:
            fits, cached = _fit_cutoff(points, data, levels)
            rows = [(r["level"], r["chi2"]) for r in fits.select("level", "chi2").collect() if r["chi2"] is not None]
            cached.unpersist()
        seen.update({lo + (k - 1) * step: c for k, c in rows if c == c})
        return rows

    try:
        rows, step = scan(low, high), (high - low) / levels
        by_level = dict(rows)
        places = [low + (k - 1) * step for k in sorted(smoothed_minima(rows), key=lambda k: by_level[k])[:most]]
        if not seen:
            raise ValueError("no cutoff leaves voxels that can be fitted")
        for at in places:
            scan(max(low, at - step), min(high, at + step))
        for _ in range(rounds - 1):
            step = 2 * step / levels
            at = min(seen, key=lambda c: (seen[c], c))
            scan(max(low, at - step), min(high, at + step))
    finally:
        data.unpersist()
    best = min(seen, key=lambda c: (seen[c], c))
    near = [c for c, v in seen.items() if v <= seen[best] * (1 + allowance)]
    return Cutoff(best, seen[best], min(near), max(near), places, weights[best], factors.get(best))
