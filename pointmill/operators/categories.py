"""Categories of atoms by element and group of hydrogens, and the volume that each displaces, by named set."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The categories, in their order.
CATEGORIES = ("H", "C", "CH", "CH2", "CH3", "N", "NH", "NH2", "NH3", "O", "OH", "S", "SH")
OTHER = "OTHER"
#: Volumes of the categories in cubic Angstrom, in the order above. Traube 1895, as in Svergun et al. 1995
#: (doi 10.1107/S0021889895007047); Voronoi and minimum-fluctuation volumes of Schaefer et al. 2001 (doi 10.1002/jcc.1137).
VOLUME_SETS = {
    "traube": (5.15, 16.44, 21.59, 26.74, 31.89, 2.49, 7.64, 12.79, 17.94, 9.13, 14.28, 19.86, 25.10),
    "voronoi_implicit": (0.0, 8.895, 12.430, 22.033, 34.092, 9.558, 14.944, 22.129, 20.641, 22.315, 23.266, 26.356, 34.192),
    "fluctuation_implicit": (0.0, 12.352, 11.640, 34.583, 41.851, 0.027, 2.181, 20.562, 20.722, 14.238, 20.911, 15.413, 28.529),
    "voronoi_explicit": (12.958, 8.658, 11.784, 20.682, 33.175, 9.144, 7.119, 5.859, 2.588, 19.167, 13.099, 25.715, 32.333),
    "fluctuation_explicit": (0.347, 12.734, 11.399, 34.828, 42.011, 0.018, 1.451, 19.064, 17.498, 14.334, 20.312, 15.242, 28.475),
}
#: Radii in Angstrom for the set of the atoms' spheres.
SPHERE_RADII = {"H": 1.1, "C": 1.96, "N": 1.79, "O": 1.71, "S": 2.06}
DEFAULT_SET = "fluctuation_implicit"


def category(element: Column, group: Column) -> Column:
    """The group where it is a category, else the element where it is one, else OTHER; capitals don't matter."""
    grouped, bare = [c for c in CATEGORIES if len(c) > 1], [c for c in CATEGORIES if len(c) == 1]
    g, e = F.upper(F.trim(group)), F.upper(F.trim(element))
    return F.when(g.isin(grouped), g).when(e.isin(bare), e).otherwise(F.lit(OTHER))


def group_of(element: Column, hydrogens: Column) -> Column:
    """The group that an element and its number of implicit hydrogens make: C and 2 give CH2."""
    return F.when(hydrogens > 0, F.concat(F.upper(element), F.lit("H"), F.when(hydrogens > 1, hydrogens.cast("string")).otherwise(F.lit("")))).otherwise(F.lit(None).cast("string"))


def radius_volumes(radii: dict[str, float]) -> tuple[float, ...]:
    """A set by the rule that a category's volume is its atoms' spheres: radii by element (H, C, N, O, S)."""

    def sphere(e: str) -> float:
        return 4 * pi / 3 * radii[e] ** 3

    return tuple(sphere(c[0]) + (sphere("H") * int(c[2:] or 1) if len(c) > 1 else 0.0) for c in CATEGORIES)


def volumes(spark: SparkSession, name: str = DEFAULT_SET, custom: dict[str, float] | None = None) -> DataFrame:
    """category, volume of a named set; a set of one's own needs all categories."""
    if custom is not None:
        if missing := set(CATEGORIES) - set(custom):
            raise ValueError(f"no volumes of {sorted(missing)}")
        rows = [(c, float(v)) for c, v in custom.items()]
    elif name == "spheres":
        rows = list(zip(CATEGORIES, radius_volumes(SPHERE_RADII), strict=True))
    elif name in VOLUME_SETS:
        rows = list(zip(CATEGORIES, VOLUME_SETS[name], strict=True))
    else:
        raise ValueError(f"no set {name}: {sorted([*VOLUME_SETS, 'spheres'])}")
    return spark.createDataFrame(rows, "category string, volume double")


def displaced(atoms: DataFrame, table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """n, volume, unknown by keys: what atoms (with category) displace; atoms of no known category count as unknown."""
    joined = atoms.join(F.broadcast(table), "category", "left")
    return joined.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"), F.count_if(F.col("volume").isNull()).alias("unknown"))
