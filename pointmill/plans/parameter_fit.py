"""Fitting a measured curve over all enabled parameters at once.

The six partial profiles of atoms (a), waters (w) and displaced volume (x) are made once and read at the measured q; they are
as many rows as the measurement has. A coarse grid over the enabled parameters, scale and offset in closed form at each
point, gives the start in one aggregation. From there damped Gauss-Newton steps follow the valley: the normal equations are
sums of one aggregation, the driver solves that handful of numbers, and steps of several dampings are judged together.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.operators.profiles import debye_waller
from pointmill.operators.spline import interpolate_at
from pointmill.ordered import number_rows
from pointmill.plans.profile_fit import partial_profiles

TERMS = ("aa", "ax", "aw", "xx", "wx", "ww")
#: Parameters, their values where they aren't enabled, and the range in which they are sought.
PARAMETERS = {"water": (1.0, 0.0, 10.0), "exv": (1.0, 0.92, 1.08), "debye_waller": (0.0, 0.0, 5.0)}


def terms(points: DataFrame) -> DataFrame:
    """q and one column for each term; a term of no pairs is 0."""
    return partial_profiles(points).groupBy("q").agg(*[F.sum(F.when(F.col("kind") == k, F.col("intensity")).otherwise(0.0)).alias(k) for k in TERMS])


def model(q: Column, values: dict[str, Column]) -> Column:
    """aa - c ax + s aw + c^2 xx - s c wx + s^2 ww, atoms' ends damped by the Debye-Waller factor."""
    s, c, d = values["water"], values["exv"], values["debye_waller"]
    damp = debye_waller(q, d)
    return damp * damp * F.col("aa") - c * damp * F.col("ax") + s * damp * F.col("aw") + c * c * F.col("xx") - s * c * F.col("wx") + s * s * F.col("ww")


def at_data(wide: DataFrame, data: DataFrame) -> DataFrame:
    """data (x, y, yerr) with the terms at each x, by splines."""
    stacked = wide.select(F.col("q").alias("x"), F.explode(F.array(*[F.struct(F.lit(t).alias("set_id"), F.col(t).alias("y")) for t in TERMS])).alias("r")).select("x", "r.set_id", "r.y")
    curves = number_rows(stacked, ["set_id"], ["x"], F.lit(0))
    asked = data.select("x").distinct().withColumn("set_id", F.explode(F.array(*map(F.lit, TERMS))))
    found = interpolate_at(curves, asked).groupBy("x").agg(*[F.max(F.when(F.col("set_id") == t, F.col("y"))).alias(t) for t in TERMS])
    return data.select("x", "y", "yerr").join(found, "x")


def landscape(rows: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """The parameters, a, b, chi2 and n for each point of a grid: y = a model + b by weights 1 / yerr^2."""
    names = list(PARAMETERS)
    table = rows.sparkSession.createDataFrame([tuple(float(g[n]) for n in names) for g in grid], ", ".join(f"{n} double" for n in names))
    m = model(F.col("x"), {n: F.col(n) for n in names})
    placed = rows.join(F.broadcast(table)).withColumn("m", m).withColumn("v", 1 / (F.col("yerr") * F.col("yerr")))
    v, y = F.col("v"), F.col("y")
    mean = placed.groupBy(*names).agg(F.sum(v).alias("s"), (F.sum(v * F.col("m")) / F.sum(v)).alias("m0"), (F.sum(v * y) / F.sum(v)).alias("y0"))
    # about the means, so that small differences of large sums don't decide
    off = placed.join(F.broadcast(mean), names).withColumns({"dm": F.col("m") - F.col("m0"), "dy": y - F.col("y0")})
    sums = off.groupBy(*names, "m0", "y0").agg(F.sum(v * F.col("dm") * F.col("dm")).alias("mm"), F.sum(v * F.col("dm") * F.col("dy")).alias("my"), F.count(F.lit(1)).alias("n"))
    line = sums.select(*names, "m0", "y0", "n", F.when(F.col("mm") > 0, F.col("my") / F.col("mm")).otherwise(0.0).alias("a"))
    left = off.drop("m0", "y0").join(F.broadcast(line.select(*names, "a", "n", (F.col("y0") - F.col("a") * F.col("m0")).alias("b"))), names)
    r = F.col("dy") - F.col("a") * F.col("dm")
    return left.groupBy(*names, "a", "b", "n").agg(F.sum(v * r * r).alias("chi2"))


def _normal(rows: DataFrame, values: dict[str, float], a: float, b: float, nudges: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations at a point: of scale, offset and the nudged parameters, their sums over the data."""

    def at(**changed: float) -> Column:
        return model(F.col("x"), {n: F.lit(float(v)) for n, v in (values | changed).items()})

    m = at()
    slopes = [m, F.lit(1.0)] + [F.lit(a) * (at(**{n: values[n] + h}) - at(**{n: values[n] - h})) / (2 * h) for n, h in nudges.items()]
    v, left = 1 / (F.col("yerr") * F.col("yerr")), F.col("y") - a * m - b
    k = len(slopes)
    sums = [F.sum(v * slopes[i] * slopes[j]) for i in range(k) for j in range(i, k)] + [F.sum(v * left * j) for j in slopes]
    found = list(rows.agg(*[x.alias(f"c{i}") for i, x in enumerate(sums)]).first())
    square = np.zeros((k, k))
    square[np.triu_indices(k)] = found[: k * (k + 1) // 2]
    return square + np.triu(square, 1).T, np.array(found[k * (k + 1) // 2 :])


def search(rows: DataFrame, enabled: dict[str, tuple[float, float]] | tuple[str, ...], steps: int = 8, rounds: int = 20) -> dict[str, float]:
    """The best point: the enabled parameters' values, a, b, chi2 and dof (rows less scale, offset and enabled parameters)."""
    if unknown := set(enabled) - set(PARAMETERS):
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    ranges = dict(enabled) if isinstance(enabled, dict) else {n: PARAMETERS[n][1:] for n in enabled}
    rows, names = rows.persist(), list(ranges)
    fixed = {n: PARAMETERS[n][0] for n in PARAMETERS}

    def best_of(points: list[dict[str, float]]):
        return landscape(rows, points).orderBy("chi2", *PARAMETERS).first()

    try:
        axes = [[low + (high - low) * i / steps for i in range(steps + 1)] for low, high in ranges.values()]
        best = best_of([fixed | dict(zip(names, p, strict=True)) for p in product(*axes)])
        for _ in range(rounds if names else 0):
            values = {n: best[n] for n in PARAMETERS}
            square, right = _normal(rows, values, best["a"], best["b"], {n: 1e-4 * (ranges[n][1] - ranges[n][0]) for n in names})
            size = 1 / np.sqrt(np.maximum(np.diag(square), 1e-300))
            tries = []
            for damping in (0.0, 1e-6, 1e-4, 1e-2, 1.0):
                scaled = square * np.outer(size, size) + damping * np.eye(len(size))
                step = size * np.linalg.lstsq(scaled, size * right, rcond=None)[0]
                tries.append(values | {n: float(np.clip(values[n] + d, *ranges[n])) for n, d in zip(names, step[2:], strict=True)})
            found = best_of(tries)
            if not found["chi2"] < best["chi2"] * (1 - 1e-9):
                break
            best = found
        return {n: best[n] for n in names} | {"a": best["a"], "b": best["b"], "chi2": best["chi2"], "dof": best["n"] - 2 - len(names)}
    finally:
        rows.unpersist()


def fit(points: DataFrame, data: DataFrame, enabled: dict[str, tuple[float, float]] | tuple[str, ...] = ("water", "exv"), steps: int = 8, rounds: int = 20) -> dict[str, float]:
    """Points of kinds a, w and x against a measured curve (x, y, yerr)."""
    return search(at_data(terms(points), data), enabled, steps, rounds)
