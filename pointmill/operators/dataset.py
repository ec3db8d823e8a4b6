"""Algebra of ordered numeric tables: projection, range filters, scaling, appending, thinning, re-binning.

Series have the columns set_id, i (place from 0), n (rows of the series), x and y; yerr where errors are known.
"""

from __future__ import annotations

from math import log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.ordered import neighbours


def select_columns(df: DataFrame, columns: list[str] | list[int]) -> DataFrame:
    """By name or by position; an empty list is an error."""
    if not columns:
        raise ValueError("no columns")
    return df.select(*[df.columns[c] if isinstance(c, int) else c for c in columns])


def rename_columns(df: DataFrame, names: dict[str, str] | list[str]) -> DataFrame:
    """One or more columns by a dict, all by a list."""
    return df.withColumnsRenamed(names) if isinstance(names, dict) else df.toDF(*names)


def limit_x(df: DataFrame, low: float, high: float, sorted_x: bool = True) -> DataFrame:
    """Rows of low <= x <= high. Where x isn't sorted, rows from the first one above high on are left out as well."""
    kept = df.where(F.col("x").between(low, high))
    if sorted_x:
        return kept
    stop = df.where(F.col("x") > high).groupBy("set_id").agg(F.min("i").alias("__stop"))
    return kept.join(stop, "set_id", "left").where(F.col("__stop").isNull() | (F.col("i") < F.col("__stop"))).drop("__stop")


def limit_y(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.where(F.col("y").between(low, high))


def scale_y(df: DataFrame, factor: float | Column) -> DataFrame:
    """y and, if there, yerr times factor."""
    return df.withColumns({c: F.col(c) * factor for c in ("y", "yerr") if c in df.columns})


def scale_errors(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in ("yerr", "xerr") if c in df.columns})


def first_y(df: DataFrame) -> DataFrame:
    """set_id and the y of its first row: one small row a series, so that it joins without a window."""
    return df.where("i = 0").select("set_id", F.col("y").alias("y0"))


def normalize(df: DataFrame, y0: float = 1.0) -> DataFrame:
    """Scales y so that each series starts at y0; adds the factor."""
    first = first_y(df).withColumnRenamed("y0", "__first")
    return scale_y(df.join(first, "set_id").withColumn("factor", F.lit(y0) / F.col("__first")), F.col("factor")).drop("__first")


def simulate_errors(df: DataFrame) -> DataFrame:
    """yerr = y0 * (1 + 0.1 / x^1.2) / 10000, as of a typical instrument."""
    return df.join(first_y(df), "set_id").withColumn("yerr", F.col("y0") * (1 + F.lit(0.1) / F.pow("x", F.lit(1.2))) * 1e-4).drop("y0")


def simulate_noise(df: DataFrame, seed: int = 42) -> DataFrame:
    """y drawn from a normal distribution around it of width yerr."""
    return df.withColumn("y", F.col("y") + F.randn(seed) * F.col("yerr"))


def random_series(spark, n: int, low: float, high: float, seed: int = 42) -> DataFrame:
    """x = 0 .. n - 1, y uniform, yerr a tenth of it."""
    y = F.lit(low) + (F.lit(high) - F.lit(low)) * F.rand(seed)
    return spark.range(n).select(F.lit(0).alias("set_id"), F.col("id").alias("i"), F.lit(n).alias("n"), F.col("id").cast("double").alias("x"), y.alias("y")).withColumn("yerr", F.col("y") * 0.1)


def append(df: DataFrame, other: DataFrame) -> DataFrame:
    """UNION ALL; both must have the same columns."""
    if len(df.columns) != len(other.columns):
        raise ValueError("different numbers of columns")
    return df.unionByName(other)


def skip_rows(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("i") >= n)


def sort_x(df: DataFrame) -> DataFrame:
    """Range-partitioned by series and x, sorted within: ordered as a whole, and in parallel."""
    return df.orderBy("set_id", "x", "i")


def remove_consecutive_duplicates(df: DataFrame) -> DataFrame:
    """Keeps a row whose y differs from the row before (equal runs keep their first row)."""
    return neighbours(df, ["set_id"], {"__before": ("y", -1)}).where((F.col("i") == 0) | (F.col("y") != F.col("__before"))).drop("__before")


def reduce_linear(df: DataFrame, target: int) -> DataFrame:
    """About target rows at equal steps of place; a shorter series stays as it is. Row i stays where floor-ing to the step changes."""
    ratio = F.col("n") / F.lit(float(target))
    bucket = F.ceil(F.col("i") / ratio)
    after = F.ceil((F.col("i") + 1) / ratio)
    return df.where((F.col("n") < target) | (bucket != after))


def reduce_log(df: DataFrame, target: int) -> DataFrame:
    """The first row, and each first row at or after a target; targets are equally spaced in log10 x from the first x to the
    last. A shorter series stays as it is."""
    ends = df.where("i = 0 OR i = n - 1").groupBy("set_id").agg(F.min_by("x", "i").alias("__a"), F.max_by("x", "i").alias("__b"))
    width = (F.log10("__b") - F.log10("__a")) / F.lit(target - 1)
    placed = df.join(ends, "set_id").withColumn("__bucket", F.floor((F.log10("x") - F.log10("__a")) / width + F.lit(1e-9)))
    kept = neighbours(placed, ["set_id"], {"__before": ("__bucket", -1)}).where((F.col("n") < target) | (F.col("i") == 0) | (F.col("__bucket") > F.col("__before")))
    return kept.drop("__a", "__b", "__bucket", "__before")


#: Rows folded into one, by the x above which they are.
FOLDS = ((0.1, 8), (0.06, 4), (0.03, 2))


def fold_groups(df: DataFrame) -> DataFrame:
    """Adds fold (the first place of the rows that are folded together). x rises along the series, so the folds follow from
    the places where it passes each threshold: no walk along the rows is needed."""
    at = df.groupBy("set_id").agg(*[F.count_if(F.col("x") <= t).alias(f"__n{size}") for t, size in FOLDS])
    start = {1: F.lit(0), 2: F.col("__n2")}
    start[4] = F.greatest(start[2], start[2] + F.ceil((F.col("__n4") - start[2]) / 2) * 2)
    start[8] = F.greatest(start[4], start[4] + F.ceil((F.col("__n8") - start[4]) / 4) * 4)
    i = F.col("i")
    fold = F.lit(None).cast("long")
    for size in (1, 2, 4, 8):
        fold = F.when(i >= start[size], start[size] + F.floor((i - start[size]) / size) * size).otherwise(fold)
    return df.join(at, "set_id").withColumn("fold", fold.cast("long")).drop(*[f"__n{size}" for _, size in FOLDS])


def rebin(df: DataFrame) -> DataFrame:
    """set_id, fold, x, y, yerr: the more rows folded into one, the larger x. Means are weighted by inverse variance where
    errors are known. Every row is folded."""
    groups = fold_groups(df).groupBy("set_id", "fold")
    if "yerr" not in df.columns:
        return groups.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.lit(0.0).alias("yerr"))
    inverse = F.sum(F.pow("yerr", F.lit(-2.0)))
    return groups.agg(F.avg("x").alias("x"), (F.sum(F.col("y") / F.pow("yerr", F.lit(2.0))) / inverse).alias("y"), F.pow(inverse, F.lit(-0.5)).alias("yerr"))


def log_targets(low: float, high: float, n: int) -> list[float]:
    step = (log10(high) - log10(low)) / (n - 1)
    return [10 ** (log10(low) + i * step) for i in range(n)]


def equal(a: DataFrame, b: DataFrame) -> bool:
    """The same rows, each as often."""
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0
