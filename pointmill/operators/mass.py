"""Sums over points: centre of mass, radius of gyration, masses by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Standard atomic masses in Dalton, and charges, of the elements of biological molecules.
ELEMENTS = (("H", 1.008, 1), ("C", 12.011, 6), ("N", 14.007, 7), ("O", 15.999, 8), ("NA", 22.990, 11), ("MG", 24.305, 12), ("P", 30.974, 15), ("S", 32.06, 16), ("CL", 35.45, 17), ("CA", 40.078, 20))


def elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ELEMENTS), "element string, mass double, charge int")


def centre_of_mass(points: DataFrame, mass: str = "w", keys: list[str] | None = None) -> DataFrame:
    total = F.sum(mass)
    return points.groupBy(*(keys or [])).agg(*[(F.sum(F.col(mass) * F.col(c)) / total).alias(f"c{c}") for c in "xyz"], total.alias("mass"))


def radius_of_gyration(points: DataFrame, weight: str = "w", mass: str = "w") -> DataFrame:
    """One row: sqrt(sum w r^2 / sum w) about the centre of mass, which is one broadcast row."""
    centre = centre_of_mass(points, mass).select("cx", "cy", "cz")
    joined = points.join(F.broadcast(centre))
    dx, dy, dz = (F.col(c) - F.col(f"c{c}") for c in "xyz")
    return joined.agg(F.sqrt(F.sum(F.col(weight) * (dx * dx + dy * dy + dz * dz)) / F.sum(weight)).alias("rg"))


def centred(points: DataFrame) -> DataFrame:
    """points moved so that their centre of mass is the origin."""
    centre = centre_of_mass(points).select("cx", "cy", "cz")
    return points.join(F.broadcast(centre)).withColumns({c: F.col(c) - F.col(f"c{c}") for c in "xyz"}).drop("cx", "cy", "cz")


def masses(points: DataFrame, dimension: DataFrame, key: str = "element", keys: list[str] | None = None) -> DataFrame:
    """Number, mass and charge by keys, from a bounded dimension table; points of no known category count without mass."""
    joined = points.join(F.broadcast(dimension), key, "left")
    return joined.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("mass", F.lit(0.0))).alias("mass"), F.sum(F.coalesce(F.col("charge").cast("long"), F.lit(0))).alias("charge"))


def implicit_volume(points: DataFrame, total_volume: float, density: float) -> DataFrame:
    """Weights less the mean charge of the displaced volume: w - density V / n."""
    n = points.agg(F.count(F.lit(1)).alias("__n"))
    return points.join(F.broadcast(n)).withColumn("w", F.col("w") - density * total_volume / F.col("__n")).drop("__n")


def compact_categories(points: DataFrame, category: str, most: int, other: str, always: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent categories stay (and those of always), all others become other."""
    counts = points.groupBy(category).agg(F.count(F.lit(1)).alias("__n"))
    kept = counts.where(~F.col(category).isin(*always, other)).orderBy(F.desc("__n"), category).limit(max(0, most - len(always) - 1)).select(category, F.lit(True).alias("__kept"))
    joined = points.join(F.broadcast(kept), category, "left")
    stays = F.col("__kept") | F.col(category).isin(*always) if always else F.col("__kept")
    return joined.withColumn(category, F.when(F.coalesce(stays, F.lit(False)), F.col(category)).otherwise(F.lit(other))).drop("__kept")
