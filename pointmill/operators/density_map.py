"""Density maps: voxels (x, y, z, val) above a cutoff, banded by level, bounded, summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statistics(voxels: DataFrame) -> DataFrame:
    """One row: mean, rms, least, greatest, sum of squares."""
    sq = F.sum(F.col("val").cast("double") * F.col("val"))
    return voxels.agg(F.avg("val").alias("mean"), F.sqrt(sq / F.count(F.lit(1))).alias("rms"), F.min("val").alias("low"), F.max("val").alias("high"), sq.alias("squares"))


def above(voxels: DataFrame, cutoff: float | Column, stride: int = 1) -> DataFrame:
    """Voxels of at least cutoff, every stride-th on each axis."""
    kept = voxels.where(F.col("val") >= cutoff)
    return kept if stride == 1 else kept.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0) & (F.col("z") % stride == 0))


def to_points(voxels: DataFrame, cutoff: float, cell: float = 1.0, stride: int = 1, weighted: bool = False) -> DataFrame:
    kept = above(voxels, cutoff, stride)
    return kept.select(F.xxhash64("x", "y", "z").alias("id"), *[(F.col(c) * cell).alias(c) for c in "xyz"], (F.col("val").cast("double") if weighted else F.lit(1.0)).alias("w"))


def level_to_cutoff(level: float, rms: float) -> float:
    return level * rms


def bands(voxels: DataFrame, levels: int, low: float, high: float) -> DataFrame:
    """voxels with band: 0 below low, then levels equal steps up to high, and levels + 1 from there. A cutoff between two
    levels then reads whole bands."""
    return voxels.withColumn("band", F.when(F.col("val") < low, 0).when(F.col("val") >= high, levels + 1).otherwise(F.floor((F.col("val") - low) / (high - low) * levels).cast("int") + 1).cast("int"))


def between_cutoffs(banded: DataFrame, low: int, high: int) -> DataFrame:
    """What a change of cutoff from one band to another adds or takes away; with the table partitioned by band, no other is read."""
    return banded.where((F.col("band") >= low) & (F.col("band") < high))


def bounds(voxels: DataFrame, cutoff: float) -> DataFrame:
    """z, x, y_min, y_max, cells of the rows that reach cutoff."""
    return voxels.where(F.col("val") >= cutoff).groupBy("z", "x").agg(F.min("y").alias("y_min"), F.max("y").alias("y_max")).withColumn("cells", F.col("y_max") - F.col("y_min") + 1)


def minimum_volume(voxels: DataFrame, cutoff: float, cell: float = 1.0) -> DataFrame:
    return bounds(voxels, cutoff).agg((F.coalesce(F.sum("cells"), F.lit(0)) * cell**3).alias("volume"))


def mass(voxels: DataFrame, cutoff: float, cell: float, density: float = 0.81) -> DataFrame:
    """Dalton of what lies above cutoff, at density Dalton in a cubic Angstrom."""
    return voxels.agg((F.count_if(F.col("val") >= cutoff) * (cell**3 * density)).alias("mass"))


def cutoff_scan(voxels: DataFrame, cutoffs: list[float], cell: float = 1.0) -> DataFrame:
    """cutoff, voxels, volume for all cutoffs in one pass."""
    counts = voxels.agg(*[F.count_if(F.col("val") >= c).alias(f"c{i}") for i, c in enumerate(cutoffs)])
    made = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"c{i}").alias("voxels")) for i, c in enumerate(cutoffs)])
    return counts.select(F.explode(made).alias("r")).select("r.cutoff", "r.voxels", (F.col("r.voxels") * cell**3).alias("volume"))


def image(voxels: DataFrame, z: int, step: int = 1) -> DataFrame:
    """x, y, val: one section of the map as an image, step by step voxels averaged into a pixel."""
    cells = [F.floor(F.col(c) / step).cast("int").alias(c) for c in "xy"]
    return voxels.where(F.col("z") == z).groupBy(*cells).agg(F.avg("val").alias("val"))
