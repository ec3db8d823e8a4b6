"""Pair histograms of points at whole coordinates: voxels of a density map, and waters placed about them.

On a lattice a distance follows from the steps along the axes, and how many pairs are how many steps apart is a correlation,
which a Fourier transform gives for all steps at once: its time grows with the box that holds the points, not with the pairs.
No pair is left out: sums of whole numbers come out whole but for rounding, far below a half, and a task that finds more fails.

The transform is dealt out: along the longest axis by columns, over the planes across it by blocks of frequencies, and back along
the longest axis by rows of steps. A task holds a column, a block of planes or a row of steps, not the box. Planes too large for a
task, boxes too empty to be worth it, points off the lattice and those of many kinds go by tiles (operators/tiles.py).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of points (group and weight) and groups of keys at most; numbers of a plane and of a column at most.
CHANNELS, GROUPS, PLANE, COLUMN = 6, 1024, 1 << 21, 1 << 22
#: Numbers of a block of planes and of a row of steps, and bytes of a task's rows, as far as one plane or column allows.
BLOCK, STEPS, PART = 1 << 20, 1 << 21, 1 << 26
#: How far a count may be from a whole number.
DRIFT = 0.1


class Box(NamedTuple):
    """Axes by falling extent, their lowest coordinates, extents and lengths of transforms."""

    axes: list[str]
    low: list[float]
    extents: list[int]
    lengths: list[int]


def fast_length(n: int) -> int:
    """The least product of 2, 3 and 5 alone that is not below n."""
    best = 1 << max(0, n - 1).bit_length()
    for five in (5**k for k in range(12)):
        for three in (3**k for k in range(18)):
            if five * three < best:
                best = min(best, five * three << max(0, math.ceil(n / (five * three)) - 1).bit_length())
    return best


def _box(found: list) -> Box:
    low = {c: min(r[f"{c}_lo"] for r in found) for c in "xyz"}
    extents = {c: int(max(r[f"{c}_hi"] for r in found) - low[c]) + 1 for c in "xyz"}
    axes = sorted("xyz", key=lambda c: -extents[c])
    return Box(axes, [low[c] for c in axes], [extents[c] for c in axes], [fast_length(2 * extents[c] - 1) for c in axes])


def _worth(found: list, box: Box, keys: list[str]) -> bool:
    """The box is no more work than the pairs, and fits."""
    (length, *plane), groups = box.lengths, {}
    for r in found:
        groups.setdefault(tuple(r[k] for k in keys), []).append(r["n"])
    work = sum(length * plane[0] * plane[1] * len(n) * (len(n) + 3) // 2 for n in groups.values())
    return plane[0] * plane[1] <= PLANE and length <= COLUMN and work <= sum(sum(n) ** 2 for n in groups.values()) / 2


def _whole(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.coalesce((v == F.floor(v)) & (F.abs(v) < float(1 << 40)), F.lit(False))


def histograms(points: DataFrame, keys: list[str], group: list[str], width: float) -> DataFrame | None:
    """keys, [group_a, group_b,] bin, value, cnt, dsum of the pairs of equal keys, those of a point with itself once and all
    others twice, by the pair of their groups (lesser first); None if this is not the way for them. points: keys, group, x, y, z, w."""
    box = {f"{c}_{s}": f(F.col(c).cast("double")) for c in "xyz" for s, f in (("lo", F.min), ("hi", F.max))}
    own = points.groupBy(*keys, *group, "w").agg(F.count(F.lit(1)).alias("n"), F.bool_and(_whole("x") & _whole("y") & _whole("z")).alias("whole"), *[v.alias(n) for n, v in box.items()])
    found = own.limit(GROUPS + 1).collect()
    kinds = sorted({tuple(r[c] for c in (*group, "w")) for r in found if all(r[c] is not None for c in (*keys, *group, "w"))})
    known = all(r["whole"] and r["w"] is not None and math.isfinite(r["w"]) and all(r[c] is not None for c in (*keys, *group)) for r in found)
    if not found or len(found) > GROUPS or len(kinds) > CHANNELS or not known:
        return None
    at = _box(found)
    if not _worth(found, at, keys):
        return None
    spark = points.sparkSession
    names = spark.createDataFrame([(k, *v) for k, v in enumerate(kinds)], "__c int, " + ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in (*group, "w")))
    placed = points.join(F.broadcast(names), [*group, "w"])  # at most CHANNELS rows
    steps = [(F.col(c).cast("double") - lo).cast("int").alias(n) for c, lo, n in zip(at.axes, at.low, ("__t", "__u", "__v"), strict=True)]
    counted = placed.select(*keys, "__c", *steps).groupBy(*keys, "__c", "__t", "__u", "__v").agg(F.count(F.lit(1)).alias("__n"))
    pairs = _correlated(counted, keys, at, len({tuple(r[k] for k in keys) for r in found}), len(kinds), width)
    a, b = (names.select(F.col("__c").alias(f"__{s}"), F.col("w").cast("double").alias(f"__w{s}"), *[F.col(g).alias(f"{g}_{s}") for g in group]) for s in "ab")
    named = pairs.join(F.broadcast(a), "__a").join(F.broadcast(b), "__b")
    sides = [f"{g}_{s}" for g in group for s in "ab"]
    return named.groupBy(*keys, *sides, "bin").agg(F.sum(F.col("cnt") * F.col("__wa") * F.col("__wb")).alias("value"), F.sum("cnt").alias("cnt"), F.sum("dsum").alias("dsum"))


def _correlated(counted: DataFrame, keys: list[str], box: Box, groups: int, channels: int, width: float) -> DataFrame:
    """keys, __a, __b (the lesser kind first), bin, cnt, dsum. counted: keys, __c, __t, __u, __v, __n."""
    (nt, nu, nv), (length, pu, pv) = box.extents, box.lengths
    half = length // 2 + 1
    deep = max(1, min(half, BLOCK // (pu * pv)))  # frequencies of a block
    blocks = math.ceil(half / deep)
    wide = max(1, min(nu, STEPS // (half * nv)))  # steps along the second axis of a row
    rows = math.ceil(nu / wide)
    cores = counted.sparkSession.sparkContext.defaultParallelism
    inside = {k: counted.schema[k].dataType.simpleString() for k in keys}
    own = "".join(f"`{k}` {t}, " for k, t in inside.items())

    def parts(bytes_: float, most: int) -> int:
        return int(max(1, min(most, max(cores, bytes_ / PART))))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(c) for c in (*keys, "__u", "__v")]
            for at in range(batch.num_rows):
                one = pa.RecordBatch.from_struct_array(batch.column("__rows")[at].values)
                c, t, n = (one.column(k).to_numpy() for k in ("__c", "__t", "__n"))
                out: list[tuple[int, int, bytes]] = []
                for k in np.unique(c):
                    wave = np.fft.rfft(np.bincount(t[c == k], n[c == k], nt), length)
                    out += [(int(k), b, wave[b * deep : (b + 1) * deep].tobytes()) for b in range(blocks)]
                arrays = [pa.array([v[at].as_py()] * len(out), v.type) for v in held] + [pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, "__u", "__v", "__c", "__block", "__data"])

    def folded(r: np.ndarray, axis: int, n: int) -> np.ndarray:
        """Steps forth and back along an axis are one."""
        r = np.moveaxis(r, axis, 0)
        out = r[:n].copy()
        out[1:] += r[: -n : -1] if n > 1 else 0
        return np.moveaxis(out, 0, axis)

    def across(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["__block"].iloc[0])
        size = min(deep, half - block * deep)
        waves = {}
        for c, of in group.groupby("__c"):
            plane = np.zeros((size, nu, nv), complex)
            for u, v, data in zip(of["__u"], of["__v"], of["__data"], strict=True):
                plane[:, u, v] = np.frombuffer(data, complex)
            waves[int(c)] = np.fft.fft2(plane, (pu, pv))
        out = []
        for a, b in combinations_with_replacement(sorted(waves), 2):
            x, y = waves[a], waves[b]
            power = (x.real * y.real + x.imag * y.imag) * (1.0 if a == b else 2.0)
            steps = folded(folded(np.fft.ifft2(power).real, 1, nu), 2, nv)
            out += [(a, b, r, block, np.ascontiguousarray(steps[:, r * wide : (r + 1) * wide]).tobytes()) for r in range(rows)]
        got = pd.DataFrame(out, columns=["__a", "__b", "__row", "__block", "__data"])
        return got.assign(**{k: group[k].iloc[0] for k in keys})[[*keys, *got.columns]]

    def back(group: pd.DataFrame) -> pd.DataFrame:
        row = int(group["__row"].iloc[0])
        here = min(wide, nu - row * wide)
        group = group.sort_values("__block")
        waves = [np.frombuffer(d, np.float64).reshape(-1, here, nv) for d in group["__data"]]
        t2, v2 = np.arange(nt, dtype=np.int64)[:, None] ** 2, np.arange(nv, dtype=np.int64)[None] ** 2
        span = int(math.sqrt((nt - 1) ** 2 + (nu - 1) ** 2 + (nv - 1) ** 2) / width + 0.5) + 2
        sums = np.zeros((2, span))
        for k in range(here):
            near = np.fft.irfft(np.concatenate([w[:, k] for w in waves]), length, axis=0)[:nt]
            number = np.rint(near)
            if np.abs(near - number).max() > DRIFT:
                raise ArithmeticError("counts of pairs on a lattice are not whole")
            number[1:] *= 2
            there = number > 0
            d = np.sqrt((t2 + (row * wide + k) ** 2 + v2)[there])
            number, bins = number[there], (d * (1.0 / width) + 0.5).astype(np.int64)
            sums[0] += np.bincount(bins, number, span)
            sums[1] += np.bincount(bins, number * d, span)
        bins = np.flatnonzero(sums[0])
        first = group.iloc[0]
        return pd.DataFrame({**{k: [first[k]] * len(bins) for k in (*keys, "__a", "__b")}, "bin": bins, "cnt": sums[0, bins].astype(np.int64), "dsum": sums[1, bins]})

    one, two = groups * channels * nu * nv * half * 16.0, groups * (channels * (channels + 1) // 2) * nu * nv * half * 8.0
    columns = counted.repartition(parts(one, groups * nu * nv), *keys, "__u", "__v").groupBy(*keys, "__u", "__v").agg(F.collect_list(F.struct("__c", "__t", "__n")).alias("__rows"))
    waves = columns.mapInArrow(forward, f"{own}__u int, __v int, __c int, __block int, __data binary")
    planes = waves.repartition(parts(one, groups * blocks), *keys, "__block").groupBy(*keys, "__block").applyInPandas(across, f"{own}__a int, __b int, __row int, __block int, __data binary")
    by = [*keys, "__a", "__b", "__row"]
    found = planes.repartition(parts(two, groups * channels * (channels + 1) // 2 * rows), *by).groupBy(*by).applyInPandas(back, f"{own}__a int, __b int, bin long, cnt long, dsum double")
    return found.groupBy(*keys, "__a", "__b", "bin").agg(F.sum("cnt").alias("cnt"), F.sum("dsum").alias("dsum"))
