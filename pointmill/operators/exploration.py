"""Exploring valleys: how far a parameter may go from its best value before chi2 rises by a share of the least.

Steps grow from tiny ones by powers of two on both sides of a guess until a wall stands on each, so no scale has to be known;
then the best value and both walls are closed in on. All series are explored at once: a round is one aggregation over the
data, which judges all candidates of all series, and the number of rounds grows with the logarithms of the guess's distance over
the first step and over the tolerance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.stored import stored

#: Candidates of a round on each side while steps grow, and within each bracket afterwards.
OUTWARD, INSIDE = 16, 10
#: Series whose candidates are broadcast to the data: 40 numbers each. More series meet their rows by a shuffle.
BROADCAST_SERIES = 50_000


def judged(df: DataFrame, asked: DataFrame, model: Callable[[Column], Column], keys: list[str], n: int, series: int, y: str = "y", error: str = "yerr") -> DataFrame:
    """keys, new: an array of (p, chi2) for the n parameters in the array __ask of asked, which has so many series. Those without a chi2 are left out."""
    few = asked.select(*keys, "__ask")
    joined = df.join(F.broadcast(few) if series <= BROADCAST_SERIES else few, keys)
    sums = joined.groupBy(*keys).agg(*[F.sum(F.pow((F.col(y) - model(F.col("__ask")[k])) / F.col(error), F.lit(2.0))).alias(f"__c{k}") for k in range(n)])
    pairs = F.zip_with("__ask", F.array(*[F.col(f"__c{k}") for k in range(n)]), lambda p, c: F.struct(p.alias("p"), c.alias("chi2")))
    return few.join(sums, keys).select(*keys, F.filter(pairs, lambda s: s["p"].isNotNull() & s["chi2"].isNotNull() & ~F.isnan(s["chi2"])).alias("new"))


def _placed(seen: DataFrame, rise: float) -> DataFrame:
    """Adds best (p, chi2), on either side the nearest (p) beyond a wall and the last before it, and best's neighbours below and
    above. Brackets may share candidates but for their last bit: neighbours are more than gap away."""
    least = F.array_min(F.transform("seen", lambda s: F.struct(s["chi2"].alias("chi2"), s["p"].alias("p"))))
    out = seen.withColumn("best", least).withColumn("bar", F.col("best.chi2") * (1 + rise))
    right = F.filter("seen", lambda s: (s["p"] > F.col("best.p")) & (s["chi2"] > F.col("bar")))
    left = F.filter("seen", lambda s: (s["p"] < F.col("best.p")) & (s["chi2"] > F.col("bar")))
    out = out.withColumns({"beyond_right": F.array_min(F.transform(right, lambda s: s["p"])), "beyond_left": F.array_max(F.transform(left, lambda s: s["p"]))})
    before_right = F.array_max(F.transform(F.filter("seen", lambda s: (s["p"] >= F.col("best.p")) & (s["p"] < F.col("beyond_right"))), lambda s: s["p"]))
    before_left = F.array_min(F.transform(F.filter("seen", lambda s: (s["p"] <= F.col("best.p")) & (s["p"] > F.col("beyond_left"))), lambda s: s["p"]))
    above = F.array_min(F.transform(F.filter("seen", lambda s: s["p"] > F.col("best.p") + F.col("gap")), lambda s: s["p"]))
    below = F.array_max(F.transform(F.filter("seen", lambda s: s["p"] < F.col("best.p") - F.col("gap")), lambda s: s["p"]))
    return out.withColumns({"before_right": before_right, "before_left": before_left, "above": above, "below": below})


def explore(df: DataFrame, start: DataFrame, model: Callable[[Column], Column], keys: list[str], rise: float = 1.0, first: float = 1e-6, tolerance: float = 1e-6, widest: float = 2.0**64, points: int = 21, y: str = "y", error: str = "yerr") -> DataFrame:
    """keys, p (of the least chi2), chi2, low and high (the walls around it, where chi2 first exceeds (1 + rise) times the
    least of those judged), mean_chi2 (of points values spread evenly from wall to wall), rounds.

    start has a row for each series with its guess; keys are never null. first is the first step (times the guess, if that
    is larger than 1); a side on which no wall stands within widest first steps has none: its wall and mean_chi2 are null.
    Walls are known to tolerance of the valley's width. A series without rows, errors or a finite chi2 isn't returned. Equal
    least values: the smallest parameter. A valley is what lies between the nearest walls: a second one beyond a wall only
    counts if one of the candidates finds a lower chi2 there."""
    step = F.greatest(F.abs("guess"), F.lit(1.0)) * first
    state = stored(start.select(*keys, F.col("guess").cast("double").alias("guess")).withColumns({"gap": F.lit(0.0), "seen": F.array().cast("array<struct<p:double,chi2:double>>")}))
    rounds, reach = 0, 1.0
    open_ones = state.withColumn("__ask", F.array(F.col("guess"), *[F.col("guess") + step * (sign * reach * 2.0**k) for k in range(OUTWARD) for sign in (-1, 1)]))
    while True:
        asked = stored(open_ones.select(*keys, "__ask"))
        if not (series := asked.count()):
            break
        new = judged(df, asked, model, keys, 2 * OUTWARD + 1, series, y, error)
        state = stored(state.join(new, keys, "left").withColumn("seen", F.concat("seen", F.coalesce("new", F.array().cast("array<struct<p:double,chi2:double>>")))).drop("new").where(F.size("seen") > 0))
        rounds, reach = rounds + 1, reach * 2.0**OUTWARD
        if reach >= widest:
            break
        unwalled = _placed(state, rise).where(F.col("beyond_right").isNull() | F.col("beyond_left").isNull())
        open_ones = unwalled.select(*keys, F.array(F.col("guess"), *[F.col("guess") + step * (sign * reach * 2.0**k) for k in range(OUTWARD) for sign in (-1, 1)]).alias("__ask"))

    def inside(a: str, b: str) -> list[Column]:
        return [F.col(a) + (F.col(b) - F.col(a)) * ((k + 1) / (INSIDE + 1)) for k in range(INSIDE)]

    for _ in range(40):  # a bracket narrows by INSIDE + 1 a round
        placed = stored(_placed(state, rise))
        ends = F.transform("seen", lambda s: s["p"])
        width = F.coalesce(F.col("beyond_right"), F.array_max(ends)) - F.coalesce(F.col("beyond_left"), F.array_min(ends))
        loose = [F.coalesce(F.abs(F.col(a) - F.col(b)) > width * tolerance, F.lit(False)) for a, b in (("beyond_left", "before_left"), ("before_right", "beyond_right"), ("below", "above"))]
        ask = F.array(*inside("beyond_left", "before_left"), *inside("before_right", "beyond_right"), *inside("below", "above"))
        asked = placed.where(loose[0] | loose[1] | loose[2]).select(*keys, ask.alias("__ask"))
        if not (series := asked.count()):
            break
        new = judged(df, asked, model, keys, 3 * INSIDE, series, y, error)
        # of those seen, the ends of the brackets and the outermost are enough
        marks = F.array("best.p", "beyond_right", "beyond_left", "before_right", "before_left", "above", "below", F.array_max(ends), F.array_min(ends))
        kept = F.filter("seen", lambda s: F.coalesce(F.array_contains("marks", s["p"]), F.lit(False)))
        slim = placed.withColumn("marks", marks).withColumn("seen", kept).select(*keys, "guess", F.coalesce((F.col("above") - F.col("below")) * 1e-6, "gap").alias("gap"), "seen")
        state = slim.join(new, keys, "left").withColumn("seen", F.concat("seen", F.coalesce("new", F.array().cast("array<struct<p:double,chi2:double>>")))).drop("new")
        rounds += 1
    found = stored(placed.select(*keys, "best", ((F.col("beyond_left") + F.col("before_left")) / 2).alias("low"), ((F.col("before_right") + F.col("beyond_right")) / 2).alias("high")))
    even = found.where("low IS NOT NULL AND high IS NOT NULL").select(*keys, F.array(*[F.col("low") + (F.col("high") - F.col("low")) * (k / (points - 1)) for k in range(points)]).alias("__ask"))
    means = judged(df, even, model, keys, points, found.count(), y, error).select(*keys, (F.aggregate("new", F.lit(0.0), lambda a, s: a + s["chi2"]) / F.size("new")).alias("mean_chi2"))
    return found.join(means, keys, "left").select(*keys, F.col("best.p").alias("p"), F.col("best.chi2").alias("chi2"), "low", "high", "mean_chi2", F.lit(rounds).alias("rounds"))
