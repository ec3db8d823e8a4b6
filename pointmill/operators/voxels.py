"""Voxel grids: occupancy, filled spheres, excluded-volume points, surfaces and holes. Grid cells are rows (i, j, k)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounding_box(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Least and greatest coordinate on each axis."""
    return points.groupBy(*(keys or [])).agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def voxel_of(value: Column, low: Column, cell: float) -> Column:
    return F.floor((value - low) / cell + 0.5).cast("long")


def to_voxels(points: DataFrame, cell: float = 1.0) -> DataFrame:
    """points with the voxel (i, j, k) that each lies in, counted from the least coordinates."""
    box = bounding_box(points)  # one row
    joined = points.join(F.broadcast(box))
    return joined.withColumns({n: voxel_of(F.col(c), F.col(f"{c}_min"), cell) for n, c in zip("ijk", "xyz", strict=True)}).drop(*box.columns)


def expand(voxels: DataFrame, radius: float, cell: float = 1.0) -> DataFrame:
    """Every voxel within radius of the centre of one of voxels, once. Each row makes a bounded number of offsets, of which
    those inside the sphere go to the distinct."""
    n = int(radius / cell)
    steps = F.sequence(F.lit(-n), F.lit(n))
    centres = voxels.select("i", "j", "k").distinct()
    grown = centres.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps)).withColumn("c", F.explode(steps))
    inside = (F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c")) * (cell * cell) <= radius * radius
    return grown.where(inside).select((F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j"), (F.col("k") + F.col("c")).alias("k")).distinct()


def volume(voxels: DataFrame, cell: float = 1.0) -> DataFrame:
    """One row: voxels, volume."""
    return voxels.select("i", "j", "k").distinct().agg(F.count(F.lit(1)).alias("voxels")).withColumn("volume", F.col("voxels") * cell**3)


def strided(voxels: DataFrame, stride: int) -> DataFrame:
    return voxels.where((F.col("i") % stride == 0) & (F.col("j") % stride == 0) & (F.col("k") % stride == 0))


def excluded_points(voxels: DataFrame, low: tuple[float, float, float], cell: float = 1.0, width: float = 1.0) -> DataFrame:
    """A point in the middle of every filled voxel that the stride of width meets, all of weight 1."""
    stride = max(1, round(width / cell))
    at = strided(voxels, stride)
    x, y, z = (F.lit(lo) + F.col(c) * cell for lo, c in zip(low, "ijk", strict=True))
    return at.select(F.xxhash64("i", "j", "k").alias("id"), x.alias("x"), y.alias("y"), z.alias("z"), F.lit(1.0).alias("w"))


_SIDES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def surface(voxels: DataFrame) -> DataFrame:
    """voxels with surface: whether one of the six neighbours is empty. Each filled voxel announces itself to its
    neighbours, and those that hear fewer than six stand at the surface: one aggregation, no join of the grid with itself."""
    filled = voxels.select("i", "j", "k").distinct()
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, "abc", strict=True)]) for s in ((0, 0, 0), *_SIDES)])
    told = filled.withColumn("o", F.explode(offsets)).select(*[(F.col(n) + F.col(f"o.{m}")).alias(n) for n, m in zip("ijk", "abc", strict=True)], (F.abs("o.a") + F.abs("o.b") + F.abs("o.c") == 0).cast("int").alias("self"))
    return told.groupBy("i", "j", "k").agg(F.sum("self").alias("self"), (F.count(F.lit(1)) - F.sum("self")).alias("near")).where("self > 0").select("i", "j", "k", (F.col("near") < 6).alias("surface"))


def holes(voxels: DataFrame, longest: int) -> DataFrame:
    """Empty voxels in gaps of up to longest between filled ones of the same column (i, j): gaps and islands along k. A
    column is bounded by the grid's height."""
    w = Window.partitionBy("i", "j").orderBy("k")
    gaps = voxels.select("i", "j", "k").distinct().withColumn("before", F.lag("k").over(w))
    short = gaps.where((F.col("k") - F.col("before") > 1) & (F.col("k") - F.col("before") - 1 <= longest))
    return short.select("i", "j", F.explode(F.sequence(F.col("before") + 1, F.col("k") - 1)).alias("k"))


def nearest_centre(points: DataFrame, centres: DataFrame) -> DataFrame:
    """id, centre, distance: the nearest of few centres (columns centre, x, y, z); the least centre of equally near ones."""
    far = points.select("id", "x", "y", "z").alias("a").join(F.broadcast(centres.alias("b")))
    dx, dy, dz = (F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz")
    d = dx * dx + dy * dy + dz * dz
    return far.select("a.id", "b.centre", d.alias("d2")).groupBy("id").agg(F.min(F.struct("d2", "centre")).alias("r")).select("id", F.col("r.centre").alias("centre"), F.sqrt("r.d2").alias("distance"))
