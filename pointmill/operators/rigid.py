"""Rigid-body refinement: many moves of bodies are tried in one job, and the best one is taken.

A move turns a body, or a group of bodies held together by constraints, about a pivot and shifts it. Distances within the
group stay, as do those between bodies that don't move, so a move's histogram is the one by pairs of bodies less the rows
that pair the group with others, plus the join of its moved points with all points of other bodies. All moves of a round are evaluated together; the driver holds
their transforms and one score each. Poses are kept as one transform a body and applied to the points as they were read, so
plans don't grow with the rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.config import DISTANCE_AXIS
from pointmill.operators import pairs, symmetry
from pointmill.operators.bodies import constraints
from pointmill.operators.fitting import chi2, regression
from pointmill.operators.profiles import q_axis, transform
from pointmill.operators.spline import splice
from pointmill.ordered import number_rows

Move = tuple[int | tuple[int, ...], np.ndarray, np.ndarray]  # body or bodies, rotation, translation
Target = tuple[tuple[int, ...], np.ndarray]  # the bodies that a move takes along, and the point about which it turns


def _group(move: Move) -> tuple[int, ...]:
    return move[0] if isinstance(move[0], tuple) else (move[0],)


def _moving(spark: SparkSession, moves: list[Move]) -> DataFrame:
    """move, moving: the bodies that each move takes along."""
    return spark.createDataFrame([(k, list(_group(m))) for k, m in enumerate(moves)], "move int, moving array<long>")


def table(spark: SparkSession, moves: list[Move]) -> DataFrame:
    """A row for each body of each move, numbered from 0 in the column copy, in the form that symmetry.copies takes."""
    rows = [(body, k, *map(float, m[1].ravel()), *map(float, m[2])) for k, m in enumerate(moves) for body in _group(m)]
    return spark.createDataFrame(rows, symmetry.TRANSFORM)


def moved(points: DataFrame, moves: list[Move]) -> DataFrame:
    """move, body, id, x, y, z, w: the points of each move's body where it puts them."""
    return symmetry.copies(points.select("body", "id", "x", "y", "z", "w"), table(points.sparkSession, moves)).withColumnRenamed("copy", "move")


def move_histograms(points: DataFrame, moves: list[Move], width: float = DISTANCE_AXIS.width) -> DataFrame:
    """move, bin, value, cnt, dsum of all pairs of points, for each move by itself."""
    slim = points.select("body", "id", "x", "y", "z", "w")
    ids = _moving(points.sparkSession, moves)
    base = pairs.pair_histogram(slim, ["body"], width)
    still = base.join(F.broadcast(ids)).where(F.array_contains("moving", F.col("body_a")) == F.array_contains("moving", F.col("body_b")))
    left, n, apart = moved(slim, moves), slim.count(), F.col("a.body") != F.col("b.body")
    if any(len(_group(m)) > 1 for m in moves):
        left, apart = left.join(F.broadcast(ids), "move"), ~F.array_contains("a.moving", F.col("b.body"))
    if n <= pairs.BROADCAST_POINTS:
        both = left.alias("a").join(F.broadcast(slim.alias("b")), apart)
    else:  # the points of each move meet those that it leaves by pairs of tiles
        others = slim.join(F.broadcast(ids)).where(~F.array_contains("moving", F.col("body"))).drop("moving")
        sums = pairs.between_histogram(left, others, ["move"], width)
        return pairs.merge(still.select("move", "bin", "value", "cnt", "dsum").unionByName(sums), ["move"])
    d = pairs.distance("a", "b")
    cross = both.select("a.move", (F.col("a.w") * F.col("b.w")).alias("v"), d.alias("d"), pairs.bin_of(d, width).alias("bin"))
    sums = cross.groupBy("move", "bin").agg((F.sum("v") * 2).alias("value"), (F.count(F.lit(1)) * 2).alias("cnt"), (F.sum("d") * 2).alias("dsum"))
    return pairs.merge(still.select("move", "bin", "value", "cnt", "dsum").unionByName(sums), ["move"])


def penalties(points: DataFrame, moves: list[Move], wanted: DataFrame) -> DataFrame:
    """move, penalty: the sum over the constraints (id_a, id_b, rest, kind). Only their end points are carried for each move."""
    ends = wanted.select(F.col("id_a").alias("id")).union(wanted.select("id_b")).distinct()
    held = points.join(ends, "id", "left_semi").select("body", "id", "x", "y", "z", F.lit(1.0).alias("w"))
    every = _moving(points.sparkSession, moves)
    rest = held.join(F.broadcast(every)).where(~F.array_contains("moving", F.col("body")))
    columns = [F.concat_ws(":", "move", "id").alias("id"), "move", "x", "y", "z"]
    both = moved(held, moves).select(*columns).union(rest.select(*columns))
    own = wanted.join(F.broadcast(every)).select(F.concat_ws(":", "move", "id_a").alias("id_a"), F.concat_ws(":", "move", "id_b").alias("id_b"), "rest", "kind")
    found = constraints(both, own).withColumn("move", F.split_part("id_a", F.lit(":"), F.lit(1)).cast("int"))
    return found.groupBy("move").agg(F.sum("penalty").alias("penalty"))


def scores(points: DataFrame, moves: list[Move], data: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """move, chi2, penalty, total: how well each move's profile, scaled and shifted, fits the measured curve."""
    return _scores(points, moves, data, wanted)[0]


def _scores(points: DataFrame, moves: list[Move], data: DataFrame, wanted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The scores, and the cached profiles that they are read from: hundreds of rows a move."""
    spark = points.sparkSession
    models = transform(move_histograms(points, moves), q_axis(spark), ["move"]).select(F.col("move").cast("int").alias("set_id"), F.col("q").alias("x"), F.col("intensity").alias("y")).persist()  # few rows, read more than once
    curves = number_rows(models, ["set_id"], ["x"], F.lit(0))
    measured = data.drop("set_id").join(F.broadcast(spark.range(len(moves)).select(F.col("id").cast("int").alias("set_id"))))
    joined = splice(curves, measured)
    fitted = chi2(joined, regression(joined, ["set_id"], x="model"), ["set_id"], x="model").select(F.col("set_id").alias("move"), "chi2")
    if wanted is None:
        return fitted.select("move", "chi2", F.lit(0.0).alias("penalty"), F.col("chi2").alias("total")), models
    both = fitted.join(penalties(points, moves, wanted), "move", "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    return both.select("move", "chi2", "penalty", (F.col("chi2") + F.col("penalty")).alias("total")), models


@dataclass(frozen=True)
class Link:
    """A constraint as bodies see it: the two bodies and its end points, where they were read."""

    body_a: int
    body_b: int
    end_a: np.ndarray
    end_b: np.ndarray


def links(points: DataFrame, wanted: DataFrame) -> list[Link]:
    """The constraints between different bodies, in order of their ids: a handful for each body, as the poses are."""
    ends = points.select("id", F.col("body").cast("long").alias("body"), "x", "y", "z")
    a = ends.select(*[F.col(c).alias(f"{c}_a") for c in ends.columns])
    b = ends.select(*[F.col(c).alias(f"{c}_b") for c in ends.columns])
    rows = wanted.join(a, "id_a").join(b, "id_b").where("body_a <> body_b").orderBy("id_a", "id_b").collect()
    return [Link(r["body_a"], r["body_b"], *(np.array([r[f"{c}_{e}"] for c in "xyz"]) for e in "ab")) for r in rows]


def connected(start: int, edges: list[Link], cut: Link | None = None) -> set[int]:
    """The bodies that constraints join to start, all but the cut one."""
    found, left = {start}, [start]
    while left:
        body = left.pop()
        near = {e.body_b if e.body_a == body else e.body_a for e in edges if e is not cut and body in (e.body_a, e.body_b)}
        left += near - found
        found |= near
    return found


def body_targets(centres: dict[int, np.ndarray], fixed: tuple[int, ...] = ()) -> list[Target]:
    """Each body alone, about its centre."""
    return [((b,), centres[b]) for b in sorted(centres) if b not in fixed]


def link_targets(edges: list[Link], sizes: dict[int, int], fixed: tuple[int, ...] = ()) -> list[Target]:
    """For each constraint the bodies on one side of it, about its end on the other side, so that the constraint and all of
    those within the side hold. The side has fewer points (the second body's if equal) and none of the fixed bodies. In a ring
    the sides are one, and the first body goes alone about its own end."""
    out = []
    for e in edges:
        one, two = connected(e.body_a, edges, e), connected(e.body_b, edges, e)
        sides = [((e.body_a,), e.end_a)] if e.body_b in one else sorted([(tuple(sorted(two)), e.end_a), (tuple(sorted(one)), e.end_b)], key=lambda s: sum(sizes[b] for b in s[0]))
        out += [s for s in sides if not set(s[0]) & set(fixed)][:1]
    return out


#: What a move changes, by the name of its mask: (turns, shifts).
MASKS = {"all": (1, 1), "rotation": (1, 0), "translation": (0, 1)}


def draw(targets: list[Target], n: int, angle: float, shift: float, rng: np.random.Generator, sequential: bool = False, first: int = 0, mask: str = "all") -> list[Move]:
    """n moves of targets, drawn at random or one after the other from the first on, turning by up to angle about the pivot
    and shifting by up to shift an axis, as far as the mask lets them. Move 0 leaves everything in its place."""
    if not targets:
        raise ValueError("nothing may move")
    turns, shifts = MASKS[mask]
    out: list[Move] = [(targets[0][0], np.eye(3), np.zeros(3))]
    for k in range(n):
        bodies, pivot = targets[(first + k) % len(targets) if sequential else int(rng.integers(len(targets)))]
        turn = symmetry.rotation(tuple(rng.normal(size=3)), turns * float(rng.uniform(-angle, angle)))
        out.append((bodies, turn, pivot - turn @ pivot + shifts * rng.uniform(-shift, shift, 3)))
    return out


@dataclass
class Refined:
    """Each body's transform, and chi2 plus penalty after each round (the first before any)."""

    poses: dict[int, tuple[np.ndarray, np.ndarray]]
    history: list[float] = field(default_factory=list)


def place(points: DataFrame, poses: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    moves = [(body, r, t) for body, (r, t) in poses.items()]
    at = symmetry.copies(points, table(points.sparkSession, moves).withColumn("copy", F.lit(0))).drop("copy")
    return at.select(*points.columns)


def refine(
    points: DataFrame, data: DataFrame, wanted: DataFrame | None = None, rounds: int = 10, tries: int = 16, angle: float = 0.5, shift: float = 5.0, fixed: tuple[int, ...] = (), seed: int = 1, select: str = "body", sequential: bool = False, mask: str = "all"
) -> Refined:
    """Greedy search: a round tries so many moves at once and takes the best if the total falls. Amplitudes decay linearly.
    Moves are of bodies, or with select="link" of what hangs together on one side of a constraint."""
    if select not in ("body", "link") or mask not in MASKS:
        raise ValueError(f"no selection {select} or mask {mask}")
    rng = np.random.default_rng(seed)
    means = points.groupBy("body").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n")).collect()  # a row for each body
    poses = {r["body"]: (np.eye(3), np.zeros(3)) for r in means}
    own = {r["body"]: np.array([r["x"], r["y"], r["z"]]) for r in means}
    sizes = {r["body"]: r["n"] for r in means}
    edges = links(points, wanted) if select == "link" and wanted is not None else []
    out = Refined(poses)
    for k in range(rounds):
        share = 1 - k / rounds

        def at(body: int, v: np.ndarray) -> np.ndarray:
            return poses[body][0] @ v + poses[body][1]

        if select == "link":
            targets = link_targets([Link(e.body_a, e.body_b, at(e.body_a, e.end_a), at(e.body_b, e.end_b)) for e in edges], sizes, fixed)
        else:
            targets = body_targets({b: at(b, c) for b, c in own.items()}, fixed)
        moves = draw(targets, tries, angle * share, shift * share, rng, sequential, k * tries, mask)
        judged, cached = _scores(place(points, poses), moves, data, wanted)
        found = {r["move"]: r["total"] for r in judged.collect()}  # a row for each move
        cached.unpersist()
        best = min(found, key=lambda m: (found[m], m))
        if not out.history:
            out.history.append(found[0])
        if found[best] < found[0]:
            _, r, t = moves[best]
            for body in _group(moves[best]):
                before = poses[body]
                poses[body] = r @ before[0], r @ before[1] + t
        out.history.append(min(found[best], found[0]))
    return out
