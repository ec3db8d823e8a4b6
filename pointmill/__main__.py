"""Programs over files: python -m pointmill fit|map|debye ..., each a Spark job whose tables go to a folder.

fit STRUCTURE MEASUREMENT    the structure's profile, scaled and shifted onto the measured curve
map MAP MEASUREMENT          the same for every cutoff of a density map
debye STRUCTURE              the structure's profile alone
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill import sinks
from pointmill.config import Q_RANGE
from pointmill.operators import density_map, map_fit
from pointmill.operators.mass import elements
from pointmill.plans import profile_fit
from pointmill.sources import registry, structures


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="pointmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for name, inputs in (("fit", ("structure", "measurement")), ("map", ("map", "measurement")), ("debye", ("structure",))):
        own = commands.add_parser(name)
        for x in inputs:
            own.add_argument(x)
        own.add_argument("--output", required=True, help="folder for the results")
        own.add_argument("--qmin", type=float, default=Q_RANGE[0])
        own.add_argument("--qmax", type=float, default=Q_RANGE[1])
        if name == "map":
            own.add_argument("--levels", type=int, default=20)
            own.add_argument("--low", type=float, default=1.0, help="lowest cutoff, in multiples of the map's rms")
            own.add_argument("--high", type=float, default=6.0, help="highest cutoff")
    return top.parse_args(given)


def points_of(spark: SparkSession, path: str) -> DataFrame:
    return structures.to_points(registry.read(spark, path), elements(spark))


def measured(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    """A curve within low to high, as set 0; errors that the file lacks are 1."""
    curve = registry.read(spark, path).where(F.col("x").between(low, high))
    return curve.withColumns({"set_id": F.lit(0), "yerr": F.coalesce("yerr", F.lit(1.0))}).select("set_id", "i", "n", "x", "y", "yerr")


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments(given)
    spark = spark or SparkSession.builder.appName("pointmill").getOrCreate()
    if a.command == "debye":
        curve = profile_fit.profile(points_of(spark, a.structure)).where(F.col("q").between(a.qmin, a.qmax))
        curve.write.mode("overwrite").parquet(f"{a.output}/profile")
        return
    data = measured(spark, a.measurement, a.qmin, a.qmax)
    if a.command == "fit":
        line, curve = profile_fit.fit(points_of(spark, a.structure), data)
        each = [("a", F.col("a"), F.col("a_err")), ("b", F.col("b"), F.col("b_err")), ("chi2", F.col("chi2"), F.lit(0.0)), ("dof", F.col("dof").cast("double"), F.lit(0.0))]
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), e.alias("error")) for n, v, e in each]))
        sinks.report(line.select(rows.alias("r")).select("r.*")).write.mode("overwrite").text(f"{a.output}/report")
        curve.drop("set_id").write.mode("overwrite").parquet(f"{a.output}/curve")
        return
    voxels = registry.read(spark, a.map)
    rms, cell = density_map.statistics(voxels).first()["rms"], voxels.agg(F.first("cell")).first()[0]
    points = map_fit.banded_points(voxels, a.levels, a.low * rms, a.high * rms, cell)
    step = (a.high - a.low) / a.levels
    fits = map_fit.fit_cutoff(points, data, a.levels).withColumn("cutoff", (a.low + (F.col("level") - 1) * step) * rms)
    fits.write.mode("overwrite").parquet(f"{a.output}/cutoffs")


if __name__ == "__main__":
    main()
