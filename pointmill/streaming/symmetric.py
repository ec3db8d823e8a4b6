"""Histograms of assemblies with symmetry, kept up to date when bodies or symmetries change.

Bodies belong to groups; a group has one symmetry, whose copies turn about the common weighted centre of its bodies (a body by
itself is a group of one). The partial table has the histogram of each scheduled pair of copies, (body_a, copy_a, body_b,
copy_b); a schedule says which pairs are needed and how often each stands for others:

- within a group of n copies, what copies g and h of two bodies see of each other is what copies 0 and g^-1 h see, n times; of
  one body with itself, inverse elements count once;
- between groups every pair of copies is its own.

A change of a body moves its group's centre, and with it the copies (but not the originals) of all bodies of the group; a
change of a group's symmetry does the same. Only scheduled pairs with such a copy are joined again. Multiplicities live in the
schedule, so that a change of symmetry alone keeps all pairs of originals.

Points of a pair of copies are dealt into tiles of about TILE, and each pair of tiles is a task of its own, whose distances are
binned in numpy (operators/tiles.py), so that two large bodies aren't one task. Ids are unique within a body. An empty table of points gives empty histograms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.config import DISTANCE_AXIS
from pointmill.operators.pairs import between_histogram, merge, within_histogram
from pointmill.operators.symmetry import copies, group, pair_schedule
from pointmill.stored import stored

KEYS = ["body_a", "copy_a", "body_b", "copy_b"]
TILE = 4096
_TURN = [f"r{a}{b}" for a in range(3) for b in range(3)]


def elements(spark: SparkSession, kinds: list[str]) -> DataFrame:
    """kind, copy, n, times (of a body's copy 0 with this one; null where its inverse stands for it), rotation: a few hundred
    rows a kind at most."""
    rows = []
    for kind in sorted(set(kinds)):
        turns = group(kind) if kind != "c1" else group("c2")[:1]
        n, times = len(turns), {k: float(len(turns)) if k == 0 else len(turns) * weight / 2 for k, weight in pair_schedule(turns)}
        rows += [(kind, k, n, times.get(k), *map(float, t.ravel())) for k, t in enumerate(turns)]
    return spark.createDataFrame(rows, "kind string, copy int, n int, times double, " + ", ".join(f"{c} double" for c in _TURN))


def centres(points: DataFrame, members: DataFrame) -> DataFrame:
    """group, cx, cy, cz: the weighted centre of a group's bodies."""
    w = F.sum("w")
    return points.join(members.select("group", "body"), "body").groupBy("group").agg(*[(F.sum(F.col("w") * F.col(c)) / w).alias(f"c{c}") for c in "xyz"])


def shared_transforms(points: DataFrame, members: DataFrame) -> DataFrame:
    """body, copy, rotation and translation of every copy of every body; members: group, body, kind (one for a group)."""
    kinds = [r["kind"] for r in members.select("kind").distinct().collect()]  # names of symmetries
    turns = elements(points.sparkSession, kinds).drop("n", "times")
    placed = members.join(turns, "kind").join(centres(points, members), "group")
    shift = [(F.col(f"c{c}") - sum((F.col(f"r{k}{m}") * F.col(f"c{d}") for m, d in enumerate("xyz")), F.lit(0.0))).alias(f"t{k}") for k, c in enumerate("xyz")]
    return placed.select("body", "copy", *_TURN, *shift)


def schedule(members: DataFrame) -> DataFrame:
    """KEYS and times of the pairs of copies that are needed; a row for each, so as many as histograms are kept."""
    spark = members.sparkSession
    kinds = [r["kind"] for r in members.select("kind").distinct().collect()]  # names of symmetries
    turns = elements(spark, kinds).select("kind", "copy", "n", "times")
    own = members.join(turns.where("times IS NOT NULL"), "kind").select(F.col("body").alias("body_a"), F.lit(0).alias("copy_a"), F.col("body").alias("body_b"), F.col("copy").alias("copy_b"), "times")
    a, b = (members.select(*[F.col(c).alias(f"{c}_{s}") for c in ("body", "group", "kind")]) for s in "ab")
    twos = a.join(b, F.col("body_a") < F.col("body_b"))  # bodies, not points
    inside = twos.where("group_a = group_b").join(turns.withColumnRenamed("kind", "kind_b"), "kind_b").select("body_a", F.lit(0).alias("copy_a"), "body_b", F.col("copy").alias("copy_b"), F.col("n").cast("double").alias("times"))
    each = turns.select("kind", "copy")
    across = twos.where("group_a <> group_b").join(each.withColumnsRenamed({"kind": "kind_a", "copy": "copy_a"}), "kind_a").join(each.withColumnsRenamed({"kind": "kind_b", "copy": "copy_b"}), "kind_b").select(*KEYS, F.lit(1.0).alias("times"))
    return own.unionByName(inside).unionByName(across)


def by_copy_pairs(points: DataFrame, members: DataFrame, keys: DataFrame, width: float = DISTANCE_AXIS.width) -> DataFrame:
    """KEYS, bin, value, cnt, dsum of the pairs of copies in keys, each pair of points twice, as in other histograms."""
    keys = stored(keys.select(*KEYS))  # a row for each histogram that is asked for
    moved = stored(copies(points.select("body", "id", "x", "y", "z", "w"), shared_transforms(points, members)))  # read for sizes, then for tasks
    same = (F.col("body_a") == F.col("body_b")) & (F.col("copy_a") == F.col("copy_b"))

    def side(s: str, wanted: DataFrame) -> DataFrame:
        named = moved.select(F.col("body").alias(f"body_{s}"), F.col("copy").cast("int").alias(f"copy_{s}"), "id", "x", "y", "z", "w")
        return wanted.select(*KEYS).join(named, [f"body_{s}", f"copy_{s}"])

    apart = between_histogram(side("a", keys.where(~same)), side("b", keys.where(~same)), KEYS, width, TILE)
    return within_histogram(side("a", keys.where(same)), KEYS, width, TILE).unionByName(apart)


def dirty_copies(members: DataFrame, bodies: DataFrame, groups: DataFrame) -> DataFrame:
    """body, copy that changes of bodies (body) and of groups' symmetries (group) move: changed bodies themselves, and all
    copies of the bodies whose group changed or has a changed body."""
    changed = bodies.select("body").distinct()
    touched = members.join(changed, "body", "left_semi").select("group").union(groups.select("group")).distinct()
    kinds = [r["kind"] for r in members.select("kind").distinct().collect()]  # names of symmetries
    turned = members.join(touched, "group", "left_semi").join(elements(members.sparkSession, kinds).select("kind", "copy"), "kind").where("copy > 0")
    return changed.select("body", F.lit(0).alias("copy")).union(turned.select("body", "copy"))


def dirty_keys(planned: DataFrame, dirty: DataFrame) -> DataFrame:
    """The scheduled pairs with a moved copy."""
    marks = [dirty.select(F.col("body").alias(f"body_{s}"), F.col("copy").alias(f"copy_{s}"), F.lit(True).alias(f"dirty_{s}")) for s in "ab"]
    both = planned.join(marks[0], ["body_a", "copy_a"], "left").join(marks[1], ["body_b", "copy_b"], "left")
    return both.where(F.coalesce("dirty_a", F.lit(False)) | F.coalesce("dirty_b", F.lit(False))).select(*KEYS)


def update(partial: DataFrame, points: DataFrame, members: DataFrame, bodies: DataFrame, groups: DataFrame, width: float = DISTANCE_AXIS.width) -> DataFrame:
    """partial after changes: points and members are the new state, bodies and groups what changed. Rows of pairs that are no
    longer scheduled go; of the others, only those with a moved copy are computed."""
    planned = schedule(members)
    moved = dirty_keys(planned, dirty_copies(members, bodies, groups))
    kept = partial.join(planned.select(*KEYS), KEYS, "left_semi").join(moved, KEYS, "left_anti")
    return kept.unionByName(by_copy_pairs(points, members, moved, width))


def assembly(partial: DataFrame, members: DataFrame) -> DataFrame:
    """bin, value, cnt, dsum of the whole assembly."""
    joined = partial.join(schedule(members), KEYS)
    return merge(joined.select("bin", (F.col("value") * F.col("times")).alias("value"), (F.col("cnt") * F.col("times")).cast("long").alias("cnt"), (F.col("dsum") * F.col("times")).alias("dsum")))
