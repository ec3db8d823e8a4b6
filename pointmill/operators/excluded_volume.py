"""Displaced solvent: histograms and profiles of atoms less the volume that they displace.

Each atom has a form factor f of its category and one x of the volume that it displaces, either its category's own (explicit)
or the same for all (average). All pair distances are those between atoms, so every term follows from the one histogram by
pair of categories: nothing is joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histograms(by_pair: DataFrame, group: str = "ff", average: bool = False) -> DataFrame:
    """term (aa, ax, xx), ff_a, ff_b, bin, value: counts of atom with atom, atom with displaced volume, volume with volume.

    ax is ordered (ff_a the atom's, ff_b the volume's); on average volumes have one category, -1."""
    a, b = f"{group}_a", f"{group}_b"
    other = F.lit(-1).cast(by_pair.schema[a].dataType)

    def row(term: str, one: Column, two: Column, value: Column) -> Column:
        return F.struct(F.lit(term).alias("term"), one.alias(a), two.alias(b), value.alias("value"))

    ca, cb, value = F.col(a), F.col(b), F.col("value")
    half = F.when(ca == cb, value).otherwise(value / 2)
    same = [row("aa", ca, cb, value), row("ax", ca, other if average else cb, half), row("xx", other if average else ca, other if average else cb, value)]
    turned = row("ax", cb, other if average else ca, half)
    every = F.explode(F.when(ca == cb, F.array(*same)).otherwise(F.array(*same, turned)))  # the pairs are read once
    return by_pair.select("bin", every.alias("r")).groupBy("r.term", f"r.{a}", f"r.{b}", "bin").agg(F.sum("r.value").alias("value"))


def terms(profiles: DataFrame, factors: DataFrame, group: str = "ff") -> DataFrame:
    """q, aa, ax, xx: profiles by pair of categories (q, ff_a, ff_b, intensity) times the factors of both ends. factors is the
    bounded table of categories and q (ff, q, f, x)."""
    one = F.broadcast(factors.select(F.col(group).alias(f"{group}_a"), "q", F.col("f").alias("__fa"), F.col("x").alias("__xa")))
    two = F.broadcast(factors.select(F.col(group).alias(f"{group}_b"), "q", F.col("f").alias("__fb"), F.col("x").alias("__xb")))
    joined = profiles.join(one, [f"{group}_a", "q"]).join(two, [f"{group}_b", "q"])
    i, fa, xa, fb, xb = (F.col(c) for c in ("intensity", "__fa", "__xa", "__fb", "__xb"))
    return joined.groupBy("q").agg(F.sum(i * fa * fb).alias("aa"), F.sum(i * (fa * xb + xa * fb)).alias("ax"), F.sum(i * xa * xb).alias("xx"))


def averaged(factors: DataFrame, weights: DataFrame, group: str = "ff") -> DataFrame:
    """factors with one x for all: the mean over the points' categories (weights: ff, n)."""
    mean = factors.join(F.broadcast(weights), group).groupBy("q").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
    return factors.drop("x").join(F.broadcast(mean), "q")


def profile(wide: DataFrame, scale: Column | float) -> DataFrame:
    """q, intensity = aa - k ax + k^2 xx, k being how displaced volume scales (see profiles.volume_scale)."""
    k = scale if isinstance(scale, Column) else F.lit(float(scale))
    return wide.select("q", (F.col("aa") - k * F.col("ax") + k * k * F.col("xx")).alias("intensity"))
