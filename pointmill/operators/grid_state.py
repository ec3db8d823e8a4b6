"""A voxel grid that bodies and waters are added to and taken from, and the states of its voxels.

The grid is a counted table (body, role, i, j, k, n): how many points of a body give a voxel a role. Adding is a union of
counts, taking away a subtraction, so that neither looks at any other body's points. A voxel's state is the or of the bits of
the roles it has from anyone; voxels without rows are empty. Rows whose count falls to 0 go. The points of one body add up
before they are shuffled; a voxel in which many bodies meet is only counted.

Null coordinates give no voxel. Repeated points count each. An empty table gives an empty grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a voxel's state.
EMPTY, VOLUME, VACUUM, ATOM_CENTRE, ATOM_AREA, WATER_CENTRE, WATER_AREA = 0, 1, 2, 4, 8, 16, 32
KEYS = ["body", "role", "i", "j", "k"]


def _sphere(radius: float, cell: float) -> list[tuple[int, int, int]]:
    n = int(radius / cell)
    steps = range(-n, n + 1)
    return [(a, b, c) for a in steps for b in steps for c in steps if (a * a + b * b + c * c) * cell * cell <= radius * radius]


def contributions(points: DataFrame, low: tuple[float, float, float], cell: float = 1.0, area: float = 1.0, volume: float = 2.0, water: str = "w") -> DataFrame:
    """What points (body, kind, x, y, z) give to the grid whose first voxel lies at low: their own voxel its centre, those
    within area their area, and those within volume (of atoms) their volume. Each point makes a bounded number of rows."""
    near, far = _sphere(area, cell), [o for o in _sphere(volume, cell) if o not in set(_sphere(area, cell))]

    def offsets(roles: list[tuple[int, list[tuple[int, int, int]]]]) -> Column:
        return F.array(*[F.struct(F.lit(role).alias("role"), *[F.lit(v).cast("long").alias(n) for v, n in zip(o, "abc", strict=True)]) for role, places in roles for o in places])

    own = [(0, 0, 0)]
    around = [o for o in near if o != (0, 0, 0)]
    each = F.when(F.col("kind") == water, offsets([(WATER_CENTRE, own), (WATER_AREA, around)])).otherwise(offsets([(ATOM_CENTRE, own), (ATOM_AREA, around), (VOLUME, far)]))
    at = [F.floor((F.col(c) - lo) / cell + 0.5).cast("long").alias(n) for c, lo, n in zip("xyz", low, "ijk", strict=True)]
    rows = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select("body", *at, F.explode(each).alias("o"))
    placed = rows.select("body", F.col("o.role").alias("role"), *[(F.col(n) + F.col(f"o.{m}")).alias(n) for n, m in zip("ijk", "abc", strict=True)])
    return placed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def merged(*grids: DataFrame) -> DataFrame:
    """The sum of counted tables, without what adds up to 0."""
    every = grids[0].select(*KEYS, "n")
    for g in grids[1:]:
        every = every.unionByName(g.select(*KEYS, "n"))
    return every.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


def add(grid: DataFrame, more: DataFrame) -> DataFrame:
    """grid with contributions() of more points."""
    return merged(grid, more)


def take_away(grid: DataFrame, gone: DataFrame) -> DataFrame:
    """grid without contributions() of points that were added before."""
    return merged(grid, gone.withColumn("n", -F.col("n")))


def without_bodies(grid: DataFrame, bodies: DataFrame) -> DataFrame:
    """grid without all that some bodies (a table of body) gave it."""
    return grid.join(bodies.select("body").distinct(), "body", "left_anti")


def without_waters(grid: DataFrame) -> DataFrame:
    return grid.where(~F.col("role").isin(WATER_CENTRE, WATER_AREA))


def with_vacuum(grid: DataFrame, voxels: DataFrame) -> DataFrame:
    """grid with voxels (such as holes()) marked as vacuum; they belong to no body."""
    marks = voxels.select("i", "j", "k").distinct().select(F.lit(None).cast(grid.schema["body"].dataType).alias("body"), F.lit(VACUUM).alias("role"), "i", "j", "k", F.lit(1).cast("long").alias("n"))
    return merged(grid, marks)


def states(grid: DataFrame) -> DataFrame:
    """i, j, k, state of every voxel that isn't empty."""
    return grid.groupBy("i", "j", "k").agg(F.bit_or("role").alias("state"))


def volume(voxel_states: DataFrame, cell: float = 1.0) -> DataFrame:
    """One row: voxels that atoms hold (their centre, area or volume) and their volume."""
    held = voxel_states.where(has(F.col("state"), ATOM_CENTRE | ATOM_AREA | VOLUME))
    return held.agg(F.count(F.lit(1)).alias("voxels")).withColumn("volume", F.col("voxels") * float(cell) ** 3)


def has(state: Column, bits: int) -> Column:
    return state.bitwiseAND(F.lit(bits)) != 0


def has_only(state: Column, bits: int) -> Column:
    """It has some of bits and no other."""
    return has(state, bits) & (state.bitwiseAND(F.lit(~bits)) == 0)


#: Tests of a voxel's state; one without a row has the state EMPTY.
TESTS = {
    "is_volume": lambda s: has(s, VOLUME),
    "is_only_volume": lambda s: has_only(s, VOLUME),
    "is_empty_or_volume": lambda s: (s == EMPTY) | has(s, VOLUME),
    "is_only_empty_or_volume": lambda s: (s == EMPTY) | has_only(s, VOLUME),
    "is_empty_or_water": lambda s: (s == EMPTY) | has(s, WATER_AREA | WATER_CENTRE),
    "is_empty_or_volume_or_water": lambda s: (s == EMPTY) | has(s, VOLUME | WATER_AREA | WATER_CENTRE),
    "is_empty": lambda s: s == EMPTY,
    "is_atom_area": lambda s: has(s, ATOM_AREA),
    "is_atom_area_or_volume": lambda s: has(s, ATOM_AREA | VOLUME),
    "is_only_atom_area_or_volume": lambda s: has_only(s, ATOM_AREA | VOLUME),
    "is_water_area": lambda s: has(s, WATER_AREA),
    "is_atom_center": lambda s: has(s, ATOM_CENTRE),
    "is_only_atom_center": lambda s: has_only(s, ATOM_CENTRE),
    "is_water_center": lambda s: has(s, WATER_CENTRE),
}


def tested(voxels: DataFrame, voxel_states: DataFrame) -> DataFrame:
    """voxels (i, j, k) with their state and a column for each test."""
    found = voxels.join(voxel_states, ["i", "j", "k"], "left").withColumn("state", F.coalesce("state", F.lit(EMPTY)))
    return found.withColumns({name: test(F.col("state")) for name, test in TESTS.items()})
