"""Operators over neighbouring rows of a series: moving averages, local extrema, spikes, boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointmill.ordered import BLOCK, blocked, neighbours


def moving_average(df: DataFrame, window: int, half_weight: bool = True, size: int = BLOCK) -> DataFrame:
    """y averaged over an odd window that shrinks symmetrically at the ends. With half_weight a row k places away weighs
    1.5^-k, else all weigh the same. Series shorter than the window are an error of the caller: they shrink to what they have."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    steps = window // 2
    near = neighbours(df, ["set_id"], {f"__y{k}": ("y", k) for k in range(-steps, steps + 1)}, size)
    reach = F.least(F.col("i"), F.col("n") - 1 - F.col("i"), F.lit(steps))
    total, weights = F.lit(0.0), F.lit(0.0)
    for k in range(-steps, steps + 1):
        weight = F.lit(1.5 ** -abs(k) if half_weight else 1.0)
        total = total + F.when(reach >= abs(k), weight * F.col(f"__y{k}")).otherwise(F.lit(0.0))
        weights = weights + F.when(reach >= abs(k), weight).otherwise(F.lit(0.0))
    return near.withColumn("y", total / weights).drop(*[f"__y{k}" for k in range(-steps, steps + 1)])


def local_minima(df: DataFrame) -> DataFrame:
    """Rows lower than both neighbours, and both ends of each series."""
    near = neighbours(df, ["set_id"], {"__a": ("y", -1), "__b": ("y", 1)})
    inner = (F.col("y") < F.col("__a")) & (F.col("y") < F.col("__b"))
    return near.where((F.col("i") == 0) | (F.col("i") == F.col("n") - 1) | inner).drop("__a", "__b")


def local_maxima(df: DataFrame) -> DataFrame:
    return local_minima(df.withColumn("y", -F.col("y"))).withColumn("y", -F.col("y"))


def spikes(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """set_id, spikes (rows more than factor times both neighbours), filled (rows other than 0), highly_ordered (more than a
    quarter of the filled rows are spikes)."""
    near = neighbours(df, ["set_id"], {"__a": ("y", -1), "__b": ("y", 1)})
    spike = (F.col("y") > factor * F.col("__a")) & (F.col("y") > factor * F.col("__b"))
    counts = near.groupBy("set_id").agg(F.count_if(spike).alias("spikes"), F.count_if(F.col("y") != 0).alias("filled"))
    return counts.withColumn("highly_ordered", F.col("spikes") > 0.25 * F.col("filled"))


def split_by_change(df: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """Adds part: from 0, one more wherever key differs from the row before. Numbered in blocks, then shifted."""
    near = neighbours(df, ["set_id"], {"__before": (key, -1)}, size).withColumn("__new", ((F.col("i") > 0) & ~F.col(key).eqNullSafe(F.col("__before"))).cast("int")).drop("__before")
    placed = near.withColumn("__block", F.floor(F.col("i") / F.lit(size)))
    sums = placed.groupBy("set_id", "__block").agg(F.sum("__new").alias("__n"))
    before = sums.withColumn("__shift", F.coalesce(F.sum("__n").over(Window.partitionBy("set_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    running = F.sum("__new").over(Window.partitionBy("set_id", "__block").orderBy("i"))
    return placed.withColumn("__own", running).join(before, ["set_id", "__block"]).withColumn("part", (F.col("__own") + F.col("__shift")).cast("long")).drop("__block", "__new", "__own", "__shift")


def blocks_of(df: DataFrame, halo: int, size: int = BLOCK) -> DataFrame:
    return blocked(df, halo, size)
