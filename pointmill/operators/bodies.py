"""Bodies: parts of a point table under one id. Splitting, merging, copying, deleting, and penalties between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_at(points: DataFrame, body: int, residues: list[int]) -> DataFrame:
    """The body's points from each residue id on become bodies of their own, numbered after the largest id."""
    steps = F.lit(0)
    for r in sorted(residues):
        steps = steps + (F.col("residue") >= r).cast("int")
    top = points.agg(F.max("body").alias("__top"))
    moved = F.when((F.col("body") == body) & (steps > 0), F.col("__top") + steps).otherwise(F.col("body"))
    return points.join(F.broadcast(top)).withColumn("body", moved.cast("long")).drop("__top")


def merge(points: DataFrame, bodies: list[int]) -> DataFrame:
    """All of bodies under the first one's id."""
    return points.withColumn("body", F.when(F.col("body").isin(bodies), F.lit(bodies[0])).otherwise(F.col("body")))


def copy(points: DataFrame, body: int, to: int) -> DataFrame:
    return points.unionByName(points.where(F.col("body") == body).withColumn("body", F.lit(to).cast(points.schema["body"].dataType)))


def delete(points: DataFrame, bodies: list[int]) -> DataFrame:
    return points.where(~F.col("body").isin(bodies))


def bonds(points: DataFrame, longest: float = 4.0) -> DataFrame:
    """body_a, body_b, id_a, id_b, distance: the shortest link between alpha carbons of neighbouring residues in two bodies.
    The join is an equi-join on the neighbouring residue, not a theta join."""
    ends = points.where("is_calpha").select("id", "body", "residue", "x", "y", "z")
    a = ends.select(*[F.col(c).alias(f"{c}_a") for c in ends.columns])
    b = ends.select(*[F.col(c).alias(f"{c}_b") for c in ends.columns]).withColumn("next", F.explode(F.array(F.col("residue_b") - 1, F.col("residue_b") + 1)))
    d = F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in "xyz"), F.lit(0.0)))
    near = a.join(b, (F.col("residue_a") == F.col("next")) & (F.col("body_a") < F.col("body_b"))).withColumn("distance", d).where(F.col("distance") <= longest)
    return near.groupBy("body_a", "body_b").agg(F.min(F.struct("distance", "id_a", "id_b")).alias("r")).select("body_a", "body_b", "r.id_a", "r.id_b", "r.distance")


def distance_penalty(distance: Column, rest: Column | float, kind: str = "bond") -> Column:
    """10 d^4 for bonds between atoms or bodies; 10 d^2 for attraction beyond and repulsion below the rest length."""
    off = distance - rest
    return {"bond": 10 * off * off * off * off, "attract": F.when(off > 0, 10 * off * off).otherwise(F.lit(0.0)), "repel": F.when(off < 0, 10 * off * off).otherwise(F.lit(0.0))}[kind]


def overlap_penalty(histogram: DataFrame) -> DataFrame:
    """One row: sum of counts weighed by exp(-5 d) over the short distances between different bodies."""
    return histogram.where("d <= 10").agg(F.coalesce(F.sum(F.col("cnt") * F.exp(-5 * F.col("d"))), F.lit(0.0)).alias("penalty"))


def constraints(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Penalty of each constraint (id_a, id_b, rest, kind): both points are found by an equi-join on their ids."""
    a = points.select(*[F.col(c).alias(f"{c}_a") for c in ("id", "x", "y", "z")])
    b = points.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "x", "y", "z")])
    d = F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in "xyz"), F.lit(0.0)))
    found = wanted.join(a, "id_a").join(b, "id_b").withColumn("distance", d)
    kind = F.col("kind")
    penalty = F.when(kind == "attract", distance_penalty(F.col("distance"), F.col("rest"), "attract")).when(kind == "repel", distance_penalty(F.col("distance"), F.col("rest"), "repel")).otherwise(distance_penalty(F.col("distance"), F.col("rest")))
    return found.withColumn("penalty", penalty).select("id_a", "id_b", "kind", "rest", "distance", "penalty")


def backbone(points: DataFrame, rest: float | None = None) -> DataFrame:
    """Constraints that hold neighbouring bodies together at the length of their bond, or at rest."""
    found = bonds(points)
    return found.select("id_a", "id_b", (F.lit(rest) if rest else F.col("distance")).alias("rest"), F.lit("bond").alias("kind"))


def thin_by_count(points: DataFrame, target: int) -> DataFrame:
    """Every k-th point (by a hash of its id) so that about target stay; no sort, no single task."""
    n = points.agg(F.count(F.lit(1)).alias("__n"))
    share = F.least(F.lit(1.0), F.lit(float(target)) / F.greatest(F.col("__n"), F.lit(1)))
    return points.join(F.broadcast(n)).where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).drop("__n")


def thin_by_score(points: DataFrame, target: int) -> DataFrame:
    """The target points of least score (the feature of this operator); ties by id."""
    return points.orderBy("score", "id").limit(target)
