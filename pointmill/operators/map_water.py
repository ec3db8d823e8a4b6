"""Waters about the shapes that a density map gives at all of its cutoffs, in one job, and cutoffs fitted with them.

Voxels are banded by density, and the shape of a level is all voxels from its band on. A place for a water, a shell away from
a voxel along an axis, serves the levels up to the highest band of a voxel that it is a shell away from, and is free from the
level on at which no voxel nearer than the clearance is left. So one join of places with voxels by cells tells the levels at
which each is free, and how many voxels are near it at each. At a level, waters keep apart as if placed one by one.

The histograms of all levels come from three joins: voxels by lesser band, waters with voxels by level and band, and waters
with each other within their level; on a lattice, one count by steps for all of them. An empty map gives empty tables; voxels repeated are voxels of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.config import DISTANCE_AXIS
from pointmill.operators import lattice
from pointmill.operators.fitting import chi2, regression
from pointmill.operators.hydration import along_axes, spaced
from pointmill.operators.map_fit import at_levels, cutoff_histograms
from pointmill.operators.pairs import cross_histogram, merge, within_histogram
from pointmill.operators.profiles import q_axis, transform
from pointmill.operators.spline import interpolate_at
from pointmill.ordered import number_rows
from pointmill.stored import stored

KINDS = ("aa", "aw", "ww")
#: Levels of one job at most: each is a count of its own beside every place.
MOST_LEVELS = 64


def _up_to(band: str, levels: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.least(F.col(band), F.lit(levels))))


def places(points: DataFrame, levels: int, shell: float = 3.0, clearance: float = 2.5, reach: float = 5.0) -> DataFrame:
    """level, x, y, z, score: the free places of each level, and how many of its voxels lie within reach. points have a band."""
    if levels > MOST_LEVELS:
        raise ValueError(f"at most {MOST_LEVELS} levels")
    made = along_axes(points.withColumn("id", F.col("band")), shell).groupBy("x", "y", "z").agg(F.max("of").alias("top"))
    width = max(clearance, reach)
    cells = [F.floor(F.col(c) / width).alias(n) for c, n in zip("xyz", "abc", strict=True)]
    side = F.explode(F.array(*[F.lit(v) for v in (-1, 0, 1)]))
    around = points.select(*[F.col(c).alias(f"p{c}") for c in "xyz"], "band", *cells).withColumn("da", side).withColumn("db", side).withColumn("dc", side)
    around = around.select("px", "py", "pz", "band", *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in "abc"])
    d2 = sum(((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    near, taken = d2 <= reach * reach, d2 < clearance * clearance
    met = made.select("*", *cells).join(around, ["a", "b", "c"])  # each has the voxel that it is made from, if the shell is no longer than the reach
    found = met.groupBy("x", "y", "z", "top").agg(F.coalesce(F.max(F.when(taken, F.col("band"))), F.lit(0)).alias("closed"), F.array(*[F.count_if(near & (F.col("band") >= k)) for k in range(1, levels + 1)]).alias("n"))
    every = made.join(found, ["x", "y", "z", "top"], "left").withColumns({"closed": F.coalesce("closed", F.lit(0)), "last": F.least("top", F.lit(levels))})
    free = every.where(F.col("closed") < F.col("last")).withColumn("level", F.explode(F.sequence(F.col("closed") + 1, F.col("last"))))
    return free.select("level", "x", "y", "z", F.coalesce(F.col("n")[F.col("level") - 1], F.lit(0)).cast("long").alias("score"))


def waters(points: DataFrame, levels: int, shell: float = 3.0, clearance: float = 2.5, reach: float = 5.0, spacing: float = 2.0) -> DataFrame:
    """level, x, y, z, score of the waters of each level: no two of a level nearer than spacing, the better ones placed first."""
    found = places(points, levels, shell, clearance, reach).withColumn("of", F.lit(0))
    return spaced(found, spacing, within=["level"]).drop("of")


def histograms(points: DataFrame, placed: DataFrame, levels: int, width: float = DISTANCE_AXIS.width) -> DataFrame:
    """level, kind (aa, aw, ww), bin, value, cnt, dsum at all levels; placed: level, x, y, z, w of waters."""
    both = [p.select(F.col("level").cast("int").alias("level"), "x", "y", "z", F.col("w").cast("double").alias("w"), F.lit(k).alias("kind")) for p, k in ((at_levels(points, levels), "a"), (placed, "w"))]
    if (found := lattice.histograms(both[0].unionByName(both[1]), ["level"], ["kind"], width)) is not None:
        return found.select("level", "bin", "value", "cnt", "dsum", F.concat("kind_a", "kind_b").alias("kind"))
    ids = placed.withColumn("id", F.xxhash64("level", "x", "y", "z"))
    # below 0 are levels of waters, from 1 on bands: the lesser of a pair's two is the water's
    marked = ids.withColumn("side", -F.col("level")), points.withColumn("side", F.col("band"))
    both = cross_histogram(*marked, ["side"], width).where("side_b >= -side_a")
    mixed = merge(both.withColumn("level", (-F.col("side_a")).cast("int")), ["level"])
    alone = cutoff_histograms(points, levels, width)
    own = within_histogram(ids, ["level"], width)
    columns = ["level", "bin", "value", "cnt", "dsum"]
    parts = [h.select(*columns, F.lit(kind).alias("kind")) for kind, h in zip(KINDS, (alone, mixed, own), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def at_data(found: DataFrame, data: DataFrame) -> DataFrame:
    """level, x, y, yerr of the data and aa, aw, ww of every level at each x, by splines."""
    profiles = stored(transform(found, q_axis(found.sparkSession), ["level", "kind"]))  # hundreds of rows a level
    names = profiles.select("level").distinct()
    # a level without waters has terms of nothing but 0
    wide = profiles.groupBy("level", "q").agg(*[F.sum(F.when(F.col("kind") == k, F.col("intensity")).otherwise(0.0)).alias(k) for k in KINDS])
    long = wide.select("q", "level", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("y")) for k in KINDS])).alias("r"))
    curves = number_rows(long.select(F.concat_ws(" ", "level", "r.kind").alias("set_id"), F.col("q").alias("x"), "r.y"), ["set_id"], ["x"], F.lit(0))
    asked = names.join(data.select("x").distinct()).select(F.explode(F.array(*[F.concat_ws(" ", "level", F.lit(k)) for k in KINDS])).alias("set_id"), "x")
    read = interpolate_at(curves, asked).withColumn("t", F.split("set_id", " "))
    terms = read.groupBy(F.col("t")[0].cast("int").alias("level"), "x").agg(*[F.max(F.when(F.col("t")[1] == k, F.col("y"))).alias(k) for k in KINDS])
    return data.select("x", "y", "yerr").join(terms, "x")


def fit_factors(rows: DataFrame, low: float = 0.0, high: float = 10.0, steps: int = 20, rounds: int = 4) -> DataFrame:
    """level, water, chi2, a, b: the best factor of the waters' weight at each level, with scale and offset in closed form.
    rows: level, x, y, yerr, aa, aw, ww. All levels are scanned together, each about its own best in the rounds after the
    first; a round is two aggregations over the data."""
    rows = stored(rows)
    best: DataFrame | None = None
    step = (high - low) / steps
    for _ in range(rounds):
        if best is None:
            centres = rows.select("level").distinct().select("level", F.lit(low).cast("double").alias("from"), F.lit(high).cast("double").alias("to"))
        else:
            centres = best.select("level", F.greatest(F.lit(low), F.col("water") - step).alias("from"), F.least(F.lit(high), F.col("water") + step).alias("to"))
            step = 2 * step / steps
        values = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.col("from") + (F.col("to") - F.col("from")) * k / steps))
        grid = centres.select("level", values.alias("water"))  # a few rows a level
        tried = rows.join(F.broadcast(grid), "level").withColumn("m", F.col("aa") + F.col("water") * F.col("aw") + F.col("water") * F.col("water") * F.col("ww"))
        line = regression(tried, ["level", "water"], x="m")
        fits = line.join(chi2(tried, line, ["level", "water"], x="m"), ["level", "water"]).where(F.col("chi2").isNotNull() & ~F.isnan("chi2"))
        best = stored(fits.groupBy("level").agg(F.min(F.struct("chi2", "water", "a", "b")).alias("r")).select("level", "r.water", "r.chi2", "r.a", "r.b"))
    return best


def masses(points: DataFrame, levels: int, low: float, high: float, cell: float = 1.0, density: float = 0.81) -> DataFrame:
    """level, cutoff, voxels, mass (Dalton): the mass axis, from one count by band."""
    by_band = points.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    summed = by_band.select(_up_to("band", levels).alias("level"), "n").groupBy("level").agg(F.sum("n").alias("voxels"))
    return summed.select("level", (F.lit(low) + (F.col("level") - 1) * F.lit((high - low) / levels)).alias("cutoff"), "voxels", (F.col("voxels") * (cell**3 * density)).alias("mass"))


def fit_cutoffs(points: DataFrame, data: DataFrame, levels: int, weight: float = 1.0, most: float = 10.0, spacing: float = 2.0, **shape: float) -> DataFrame:
    """level, water, chi2, a, b, waters: the measured curve against every cutoff with waters about its shape, the factor of
    their weight fitted up to most. shape: shell, clearance and reach of places()."""
    placed = stored(waters(points, levels, spacing=spacing, **shape).withColumn("w", F.lit(float(weight))))  # read three times
    fits = fit_factors(at_data(histograms(points, placed, levels), data), high=most)
    n = placed.groupBy("level").agg(F.count(F.lit(1)).alias("waters"))
    return fits.join(n, "level", "left").withColumn("waters", F.coalesce("waters", F.lit(0)))
