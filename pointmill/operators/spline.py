"""Cubic splines along series, and what is read off them.

The spline is the natural one (no curvature at its ends). Its equations couple all knots, but a knot's pull fades by more
than a factor of three with each knot passed; so a series is solved in blocks that overlap by HALO knots, which leaves no
difference that a double can hold, and no task holds a whole series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointmill.ordered import BLOCK, blocked, neighbours
from pointmill.stored import stored

HALO = 64


def second_derivatives(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At the knots, zero at both ends: the tridiagonal equations of the natural spline, solved by elimination."""
    n = len(x)
    out = np.zeros(n)
    if n < 3:
        return out
    h = np.diff(x)
    slope = np.diff(y) / h
    main, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope)
    for i in range(1, n - 2):
        f = h[i] / main[i - 1]
        main[i] -= f * h[i]
        right[i] -= f * right[i - 1]
    out[n - 2] = right[-1] / main[-1]
    for i in range(n - 4, -1, -1):
        out[i + 1] = (right[i] - h[i + 1] * out[i + 2]) / main[i]
    return out


def coefficients(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """set_id, i, x, x1, y, c1, c2, c3: for each interval from a knot to the next, y + c1 t + c2 t^2 + c3 t^3 with t = x - knot.
    x rises strictly along a series of at least four knots."""
    kind = df.schema["set_id"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        if len(x) < 2:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        m, h = second_derivatives(x, y), np.diff(x)
        out = pdf.iloc[:-1][["set_id", "i", "n", "core"]].copy()
        out["x"], out["x1"], out["y"] = x[:-1], x[1:], y[:-1]
        out["c1"] = np.diff(y) / h - h * (2 * m[:-1] + m[1:]) / 6
        out["c2"], out["c3"] = m[:-1] / 2, np.diff(m) / (6 * h)
        return out[out["core"]].drop(columns="core")

    schema = f"set_id {kind}, i long, n long, x double, x1 double, y double, c1 double, c2 double, c3 double"
    return blocked(df.select("set_id", "i", "n", F.col("x").cast("double"), F.col("y").cast("double")), HALO, size).groupBy("set_id", "block").applyInPandas(solve, schema)


def _value(t) -> F.Column:
    return F.col("y") + F.col("c1") * t + F.col("c2") * t * t + F.col("c3") * t * t * t


def interpolate_between(df: DataFrame, n: int) -> DataFrame:
    """set_id, x, y: each knot but the last, and n points evenly in each interval after it."""
    own = coefficients(df).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    t = (F.col("x1") - F.col("x")) * F.col("k") / (n + 1)
    return own.select("set_id", (F.col("i") * (n + 1) + F.col("k")).alias("place"), (F.col("x") + t).alias("x_new"), _value(t).alias("y")).withColumnRenamed("x_new", "x")


def interpolate_at(df: DataFrame, at: DataFrame, buckets: int = 256) -> DataFrame:
    """set_id, x, y at the x of at (set_id, x), beyond the ends by the outermost cubics.

    A range join through buckets of x: an interval goes to the buckets that it covers, a point to its own, and the
    condition picks the interval. Points outside are put at the ends first."""
    pieces = coefficients(df)
    ends = df.groupBy("set_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / buckets

    def bucket(x):
        return F.least(F.greatest(F.floor((x - F.col("lo")) / width), F.lit(0)), F.lit(buckets - 1))

    covers = pieces.join(ends, "set_id").withColumn("bucket", F.explode(F.sequence(bucket(F.col("x")), bucket(F.col("x1")))))
    covers = covers.select("set_id", "bucket", "i", "n", F.col("x").alias("x0"), "x1", "y", "c1", "c2", "c3")
    asked = at.select("set_id", F.col("x").alias("x_new")).join(ends, "set_id").withColumn("bucket", bucket(F.col("x_new"))).withColumn("inside", F.least(F.greatest("x_new", "lo"), F.col("hi")))
    last = (F.col("i") == F.col("n") - 2) & (F.col("inside") == F.col("x1"))
    hit = asked.join(covers, ["set_id", "bucket"]).where((F.col("inside") >= F.col("x0")) & ((F.col("inside") < F.col("x1")) | last))
    return hit.select("set_id", F.col("x_new").alias("x"), _value(F.col("x_new") - F.col("x0")).alias("y"))


def splice(model: DataFrame, data: DataFrame) -> DataFrame:
    """data with model: the model curve, by set, at each measured x."""
    return data.join(interpolate_at(model, data.select("set_id", "x").distinct()).withColumnRenamed("y", "model"), ["set_id", "x"])


def _climbs(y: np.ndarray, top: np.ndarray, order: range) -> np.ndarray:
    """For each of a row of minima, how high the curve climbs, going back along order, before it falls to that minimum's
    height or below it: (height, True) where it does so, else the height reached at the end and False. top[k] is the highest
    point between minima k and k + 1."""
    out, settled = np.full(len(y), -np.inf), np.zeros(len(y), bool)
    forward = order.step > 0
    stack: list[tuple[float, float]] = []  # minima not undercut so far, and the height between each and the one after it
    last = None
    for k in order:
        climbed = -np.inf if last is None else (top[k - 1] if forward else top[k])
        while stack and stack[-1][0] > y[k]:
            climbed = max(climbed, stack.pop()[1])
        out[k], settled[k] = climbed, bool(stack)
        stack.append((y[k], climbed))
        last = k
    return np.stack([out, settled])


def _judged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sets left and right (how high the curve climbs on either side) and whether each is known, where it isn't yet; adds
    height (the lower of both) and settled: whether minima beyond these rows could not change it."""
    y, top, out = pdf["y"].to_numpy(), pdf["top"].to_numpy(), pdf.copy()
    for side, order in (("left", range(len(y))), ("right", range(len(y) - 1, -1, -1))):
        climb, known = _climbs(y, top, order)
        before = pdf[f"{side}_known"].to_numpy() if f"{side}_known" in pdf else np.zeros(len(y), bool)
        out[side] = np.where(before, pdf[side], climb) if before.any() else climb
        out[f"{side}_known"] = before | (known > 0)
    left, right, left_known, right_known = (out[c].to_numpy() for c in ("left", "right", "left_known", "right_known"))
    out["height"] = np.where(left_known & right_known, np.minimum(left, right), np.where(left_known, left, np.where(right_known, right, np.inf)))
    # a side that is open can only climb higher: it doesn't matter once it is above the other, known one
    out["settled"] = (left_known & right_known) | (left_known & (right >= left)) | (right_known & (left >= right))
    return out


def find_minima(df: DataFrame, min_spacing: int = 1, min_prominence: float = 0.0, size: int = BLOCK) -> DataFrame:
    """set_id, i, x, y, prominence: minima whose relative prominence (how far the curve climbs on the lower of both sides
    before it falls to the minimum's height or below, over the range of y; the whole range for a minimum that nothing
    undercuts) is at least min_prominence, and that stand min_spacing rows apart; of closer ones the lower stays, of equal
    ones the first.

    This topographic prominence is a choice of ours: it depends on the curve alone, not on how bounds are grown and merged.
    Rows are read once in blocks: each gives the minima whose climbs are settled inside it, and its open ones (those that
    nothing in the block undercuts on one side), of which a block of m minima has about 2 ln m. Only these meet by series."""
    kind = df.schema["set_id"].dataType.simpleString()
    slim = stored(df.select("set_id", "i", "n", F.col("x").cast("double"), F.col("y").cast("double")))  # read five times
    # flat stretches are no minima, but a climb ends where it falls to one
    near = neighbours(slim, ["set_id"], {"__a": ("y", -1), "__b": ("y", 1)}, size)
    is_end = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    strict = is_end | ((F.col("y") < F.col("__a")) & (F.col("y") < F.col("__b")))
    low = stored(near.where(is_end | ((F.col("y") <= F.col("__a")) & (F.col("y") <= F.col("__b")))).select("set_id", "i", "x", "y", strict.alias("strict"), F.floor(F.col("i") / F.lit(size)).alias("block")))
    # the highest row from each minimum on, up to the next one of its block: rows are numbered by the minima before them
    marked = slim.join(low.select("set_id", "i", F.lit(1).alias("low")), ["set_id", "i"], "left").withColumn("block", F.floor(F.col("i") / F.lit(size)))
    stretch = F.count("low").over(Window.partitionBy("set_id", "block").orderBy("i"))
    tops = stored(marked.withColumn("stretch", stretch).groupBy("set_id", "block", "stretch").agg(F.max("y").alias("top"), F.min("i").alias("i")))
    # a block's first rows, before its first minimum, belong to the stretch of the block before; they raise its last top
    leads = tops.where("stretch = 0").select("set_id", "block", F.col("top").alias("lead"))
    own = low.join(tops.where("stretch > 0").select("set_id", "i", "top"), ["set_id", "i"])

    def by_block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _judged(pdf.sort_values("i", ignore_index=True))
        return out[columns]

    columns = ["set_id", "block", "i", "x", "y", "strict", "top", "left", "left_known", "right", "right_known", "height", "settled"]
    schema = f"set_id {kind}, block long, i long, x double, y double, strict boolean, top double, left double, left_known boolean, right double, right_known boolean, height double, settled boolean"
    found = stored(own.groupBy("set_id", "block").applyInPandas(by_block, schema))
    span = slim.groupBy("set_id").agg((F.max("y") - F.min("y")).alias("span"), F.max("y").alias("highest"))

    def by_series(records: pd.DataFrame, leads: pd.DataFrame) -> pd.DataFrame:
        """Records of all blocks, with the heights of what was left out between them, judged once more."""
        pdf = records.sort_values("i", ignore_index=True)
        lead = dict(zip(leads["block"], leads["lead"], strict=True))
        if len(pdf):
            block, top = pdf["block"].to_numpy(), pdf["top"].to_numpy().copy()
            for k in range(len(pdf) - 1):  # between two records: every block begun since, and none more
                for b in range(int(block[k]) + 1, int(block[k + 1]) + 1):
                    top[k] = max(top[k], lead.get(b, -np.inf))
            pdf["top"] = top
        return _judged(pdf)[["set_id", "i", "x", "y", "height"]]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's records, each with the highest row up to the next record of the block."""
        pdf = pdf.sort_values("i", ignore_index=True)
        at = np.flatnonzero(~(pdf["left_known"] & pdf["right_known"]).to_numpy())
        out = pdf.iloc[at].copy()
        out["top"] = np.maximum.reduceat(pdf["top"].to_numpy(), at) if len(at) else []
        return out[columns]

    chains = found.groupBy("set_id", "block").applyInPandas(chain, schema)
    late = chains.groupBy("set_id").cogroup(leads.groupBy("set_id")).applyInPandas(by_series, f"set_id {kind}, i long, x double, y double, height double")
    heights = found.where("strict AND settled").select("set_id", "i", "x", "y", "height").unionByName(late.join(found.where("strict AND NOT settled").select("set_id", "i"), ["set_id", "i"], "left_semi"))
    reach = F.greatest(F.when(F.col("height") < F.lit(float("inf")), F.col("height")).otherwise(F.col("highest")) - F.col("y"), F.lit(0.0))
    kept = heights.join(span, "set_id").withColumn("prominence", reach / F.greatest("span", F.lit(1e-300))).where(F.col("prominence") >= min_prominence).select("set_id", "i", "x", "y", "prominence")
    return kept if min_spacing <= 1 else _spaced(kept, min_spacing, size)


def _spaced(minima: DataFrame, spacing: int, size: int) -> DataFrame:
    """Of minima closer than spacing the lowest stays, and so on with those left. Minima fall into runs at each gap of at
    least spacing, which don't touch each other: runs, not series, are the groups."""
    own_block = F.floor(F.col("i") / F.lit(size))
    near = minima.withColumn("__block", F.explode(F.array_distinct(F.array(own_block, F.floor((F.col("i") + spacing) / F.lit(size))))))
    before = F.lag("i").over(Window.partitionBy("set_id", "__block").orderBy("i"))
    marked = near.withColumn("__new", F.coalesce(F.col("i") - before >= spacing, F.lit(True)).cast("long")).where(F.col("__block") == own_block)
    starts = marked.groupBy("set_id", "__block").agg(F.sum("__new").alias("__n"))
    shift = starts.withColumn("__shift", F.sum("__n").over(Window.partitionBy("set_id").orderBy("__block")) - F.col("__n")).drop("__n")
    running = F.sum("__new").over(Window.partitionBy("set_id", "__block").orderBy("i"))
    placed = marked.withColumn("__own", running).join(shift, ["set_id", "__block"]).withColumn("run", F.col("__own") + F.col("__shift"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        place, taken, chosen = pdf["i"].to_numpy(), {}, []  # a stretch as long as the spacing has one at most
        for k in np.argsort(pdf["y"].to_numpy(), kind="stable").tolist():
            at = int(place[k])
            if all(abs(at - taken[b]) >= spacing for b in (at // spacing - 1, at // spacing, at // spacing + 1) if b in taken):
                taken[at // spacing] = at
                chosen.append(k)
        return pdf.loc[sorted(chosen), ["set_id", "i", "x", "y", "prominence"]]

    kind = minima.schema["set_id"].dataType.simpleString()
    return placed.select("set_id", "run", "i", "x", "y", "prominence").groupBy("set_id", "run").applyInPandas(choose, f"set_id {kind}, i long, x double, y double, prominence double")
