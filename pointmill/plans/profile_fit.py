"""From points and a measured curve to a fitted curve: histogram, transform, interpolation, regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.config import DISTANCE_AXIS
from pointmill.operators.dataset import reduce_log, simulate_errors
from pointmill.operators.fitting import chi2, regression, residuals
from pointmill.operators.pairs import kinds, merge, pair_histogram
from pointmill.operators.profiles import q_axis, transform
from pointmill.operators.spline import splice
from pointmill.ordered import number_rows
from pointmill.stored import stored


def profile(points: DataFrame, width: float = DISTANCE_AXIS.width) -> DataFrame:
    """q, intensity of all pairs of points."""
    return transform(pair_histogram(points, width=width), q_axis(points.sparkSession))


def partial_profiles(points: DataFrame, width: float = DISTANCE_AXIS.width) -> DataFrame:
    """q, kind, intensity: one profile for each pair of kinds."""
    return transform(merge(kinds(points, "kind", width), ["kind"]), q_axis(points.sparkSession), ["kind"])


def as_curve(profiles: DataFrame, set_id: int = 0) -> DataFrame:
    """A profile as a series: few rows, so one chunk."""
    return number_rows(profiles.select(F.lit(set_id).alias("set_id"), F.col("q").alias("x"), F.col("intensity").alias("y")), ["set_id"], ["x"], F.lit(0))


def simulate(points: DataFrame, n: int, by_kind: bool = False) -> DataFrame:
    """A measured curve as the points would give: about n rows at logarithmic steps, with errors. By kind, it is the sum of
    the partial profiles, whose bins have mean distances of their own."""
    whole = partial_profiles(points).groupBy("q").agg(F.sum("intensity").alias("intensity")) if by_kind else profile(points)
    return simulate_errors(reduce_log(as_curve(stored(whole)), n))  # few rows, read many times


def fit(points: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parameters with chi2 and dof, curve with model, y_fit and residual) of data = a model + b."""
    joined = splice(as_curve(profile(points).persist()), data)  # few rows, read more than once
    line = regression(joined, ["set_id"], x="model")
    return line.join(chi2(joined, line, ["set_id"], x="model"), "set_id"), residuals(joined, line, ["set_id"], x="model")


def fit_water_scale(points: DataFrame, data: DataFrame, scales: list[float]) -> DataFrame:
    """scale, chi2, a, b: the partial profiles are made once; every scale is regressed in the same aggregation."""
    wide = partial_profiles(points).groupBy("q").agg(*[F.sum(F.when(F.col("kind") == k, F.col("intensity")).otherwise(0.0)).alias(k) for k in ("aa", "aw", "ww")]).persist()  # few rows, read more than once
    grid = F.explode(F.array(*[F.lit(float(s)) for s in scales]))
    models = wide.withColumn("set_id", grid).select("set_id", F.col("q").alias("x"), (F.col("aa") + F.col("set_id") * F.col("aw") + F.col("set_id") * F.col("set_id") * F.col("ww")).alias("y"))
    curves = number_rows(models, ["set_id"], ["x"], F.lit(0))
    measured = data.drop("set_id").withColumn("set_id", grid)
    joined = splice(curves, measured)
    line = regression(joined, ["set_id"], x="model")
    return line.join(chi2(joined, line, ["set_id"], x="model"), "set_id").select(F.col("set_id").alias("scale"), "chi2", "a", "b")
