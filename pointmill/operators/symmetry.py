"""Symmetric copies: tables of affine transforms, joined to the points of their body."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from math import cos, pi, sin

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pointmill.config import DISTANCE_AXIS
from pointmill.operators.pairs import cross_histogram, merge, pair_histogram

TRANSFORM = "body long, copy int, r00 double, r01 double, r02 double, r10 double, r11 double, r12 double, r20 double, r21 double, r22 double, t0 double, t1 double, t2 double"


def rotation(axis: tuple[float, float, float], angle: float) -> np.ndarray:
    """By the formula of Rodrigues."""
    x, y, z = np.array(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + sin(angle) * k + (1 - cos(angle)) * (k @ k)


def closed(generators: list[np.ndarray], most: int = 120) -> list[np.ndarray]:
    """The group that the rotations generate, the identity first."""
    found = [np.eye(3)]
    queue = [np.eye(3)]
    while queue:
        a = queue.pop(0)
        for g in generators:
            b = a @ g
            if not any(np.allclose(b, f, atol=1e-8) for f in found):
                if len(found) >= most:
                    raise ValueError("the rotations don't close to a small group")
                found.append(b)
                queue.append(b)
    return found


def group(name: str) -> list[np.ndarray]:
    """Rotations of a named symmetry: c2, c3 ..., d2, d3 ..., dp2, dp3 ... (the same, about a centre in the plane), t, o, i;
    a-b composes (copies of a, each copied by b). A free single copy is no group: see free_copy."""
    if "-" in name:
        inner, outer = name.split("-", 1)
        return [b @ a for b, a in itertools.product(group(outer), group(inner))]
    z, x = (0, 0, 1), (1, 0, 0)
    if name[0] == "c" and name[1:].isdigit():
        return closed([rotation(z, 2 * pi / int(name[1:]))])
    if name[0] == "d" and (n := name[1:].removeprefix("p")).isdigit():
        return closed([rotation(z, 2 * pi / int(n)), rotation(x, pi)])
    golden = (1 + 5**0.5) / 2
    generators = {"t": [rotation(z, pi), rotation((1, 1, 1), 2 * pi / 3)], "o": [rotation(z, pi / 2), rotation((1, 1, 1), 2 * pi / 3)], "i": [rotation((0, 1, golden), 2 * pi / 5), rotation((1, 1, 1), 2 * pi / 3)]}
    if name not in generators:
        raise ValueError(f"unknown symmetry {name}")
    return closed(generators[name])


def transforms(spark: SparkSession, bodies: dict[int, list[np.ndarray]], centre: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """A row for each body and copy; rotations are about centre. At most a few hundred rows a body."""
    rows = []
    for body, rotations in bodies.items():
        for copy, r in enumerate(rotations):
            t = np.array(centre) - r @ np.array(centre)
            rows.append((body, copy, *map(float, r.ravel()), *map(float, t)))
    return spark.createDataFrame(rows, TRANSFORM)


def free_copy(spark: SparkSession, body: int, turn: np.ndarray, shift: tuple[float, float, float], centre: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """The table of a body and one copy of it, turned about centre and shifted."""
    c = np.array(centre, float)
    rows = [(body, 0, *map(float, np.eye(3).ravel()), 0.0, 0.0, 0.0), (body, 1, *map(float, turn.ravel()), *map(float, c - turn @ c + np.array(shift)))]
    return spark.createDataFrame(rows, TRANSFORM)


def copies(points: DataFrame, table: DataFrame) -> DataFrame:
    """points of each body under each of its transforms: adds copy, moves x, y, z. Spark broadcasts the table where it is small."""
    joined = points.join(table, "body")
    moved = {c: sum((F.col(f"r{k}{m}") * F.col(d) for m, d in enumerate("xyz")), F.lit(0.0)) + F.col(f"t{k}") for k, c in enumerate("xyz")}
    return joined.withColumns(moved).drop(*[f"r{a}{b}" for a in range(3) for b in range(3)], "t0", "t1", "t2")


def pair_schedule(rotations: list[np.ndarray]) -> list[tuple[int, int]]:
    """(copy, multiplicity): in a group, the distances between copies a and b are those between copy 0 and a^-1 b. So only
    pairs with copy 0 are needed, inverse ones once with double weight."""
    out, seen = [], set()
    for k, r in enumerate(rotations):
        if k in seen:
            continue
        inverse = next((m for m, q in enumerate(rotations) if np.allclose(q, r.T, atol=1e-8)), k)
        seen |= {k, inverse}
        out.append((k, 1 if inverse == k else 2))
    return out


def histogram(points: DataFrame, rotations: list[np.ndarray], centre: tuple[float, float, float] = (0, 0, 0), width: float = DISTANCE_AXIS.width) -> DataFrame:
    """bin, value, cnt, dsum of the assembly that a group of rotations makes of points: as if all copies were joined with
    each other, from copy 0 with itself and with the scheduled copies alone."""
    n, spark = len(rotations), points.sparkSession
    schedule = [(k, weight) for k, weight in pair_schedule(rotations) if k]
    own = pair_histogram(points, width=width).select("bin", *[(F.col(c) * n).alias(c) for c in ("value", "cnt", "dsum")])
    if not schedule:
        return own
    one = points.select(F.lit(0).cast("long").alias("body"), "id", "x", "y", "z", "w")
    moved = transforms(spark, {0: rotations}, centre).where(F.col("copy").isin([k for k, _ in schedule]))
    others = copies(one, moved)
    times = F.broadcast(spark.createDataFrame([(k, n * weight / 2) for k, weight in schedule], "copy_b int, times double"))
    cross = cross_histogram(one.withColumn("copy", F.lit(0)), others, ["copy"], width).join(times, "copy_b")
    both = cross.select("bin", *[(F.col(c) * F.col("times")).cast(t).alias(c) for c, t in (("value", "double"), ("cnt", "long"), ("dsum", "double"))])
    return merge(own.unionByName(both))


def moments(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row by keys of the sums from which the superposition of point pairs (ax .. az onto bx .. bz) follows."""
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(f"{s}{c}").alias(f"s_{s}{c}") for s in "ab" for c in "xyz"]
    sums += [F.sum(F.col(f"a{c}") * F.col(f"b{d}")).alias(f"m_{c}{d}") for c in "xyz" for d in "xyz"]
    sums += [F.sum(F.col(f"a{c}") * F.col(f"a{d}")).alias(f"a_{c}{d}") for c in "xyz" for d in "xyz"]
    sums += [F.sum(sum((F.col(f"{s}{c}") * F.col(f"{s}{c}") for c in "xyz"), F.lit(0.0))).alias(f"q_{s}") for s in "ab"]
    return pairs.groupBy(*(keys or [])).agg(*sums)


@dataclass
class Moments:
    """The sums of one superposition as arrays."""

    n: int
    a: np.ndarray
    b: np.ndarray
    ab: np.ndarray
    aa: np.ndarray
    bb: float

    @classmethod
    def of(cls, r: Row) -> Moments:
        square = lambda k: np.array([[r[f"{k}_{c}{d}"] for d in "xyz"] for c in "xyz"])
        return cls(r["n"], *(np.array([r[f"s_{s}{c}"] for c in "xyz"]) for s in "ab"), square("m"), square("a"), r["q_b"])

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Rotation and translation that bring a nearest to b."""
        u, _, vt = np.linalg.svd(self.ab - np.outer(self.a, self.b) / self.n)
        turn = (u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt).T
        return turn, (self.b - turn @ self.a) / self.n

    def square_distance(self, turn: np.ndarray, shift: np.ndarray) -> float:
        """The sum of squares of turn a + shift - b."""
        own = np.trace(turn @ self.aa @ turn.T) + self.n * shift @ shift + self.bb
        return float(own + 2 * shift @ (turn @ self.a) - 2 * np.trace(turn @ self.ab) - 2 * shift @ self.b)


def superpose(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation and root mean square distance of the best superposition: the sums come from Spark, what is left
    is a singular value decomposition of 3 by 3 numbers."""
    m = Moments.of(moments(pairs).first())
    turn, shift = m.best()
    return turn, shift, float(np.sqrt(max(0.0, m.square_distance(turn, shift)) / m.n))


@dataclass
class Decomposed:
    """A symmetry's centre and frame, which copy each rotation of its group gives, and how far copies lie from there."""

    centre: np.ndarray
    frame: np.ndarray
    order: list[int]
    rms: float


def _fitted(own: list[Moments], turns: list[np.ndarray], shifts: list[np.ndarray], rotations: list[np.ndarray], order: list[int], mean: np.ndarray) -> Decomposed:
    """order: the copy that each rotation but the identity gives."""
    # the centre stays under every copy's transform: (1 - R) c = t; what that leaves open lies nearest to the mean
    left = np.concatenate([np.eye(3) - turns[k] for k in order])
    centre = mean + np.linalg.pinv(left, rcond=1e-6) @ (np.concatenate([shifts[k] for k in order]) - left @ mean)
    # the frame F satisfies R F = F G for every copy: a linear condition, of which the solution nearest to 1 is taken
    rows = np.concatenate([np.kron(turns[k], np.eye(3)) - np.kron(np.eye(3), g.T) for k, g in zip(order, rotations[1:], strict=True)])
    _, size, vt = np.linalg.svd(rows)
    free = vt[[i for i in range(9) if size[i] <= max(1e-6, 1.01 * size[-1])]]
    best = None
    for start in (np.eye(3), rotation((1, 2, 3), 1.0), rotation((3, -1, 2), 2.5)):
        u, _, wt = np.linalg.svd((free.T @ (free @ start.ravel())).reshape(3, 3))
        frame = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ wt))]) @ wt
        total = 0.0
        for k, g in zip(order, rotations[1:], strict=True):
            turn = frame @ g @ frame.T
            total += own[k].square_distance(turn, centre - turn @ centre)
        rms = float(np.sqrt(max(0.0, total) / sum(own[k].n for k in order)))
        if best is None or rms < best.rms:
            best = Decomposed(centre, frame, order, rms)
    return best


def decompose(points: DataFrame, name: str, accept: float = 0.5, most: int = 9) -> Decomposed:
    """How well points (copy, id, x, y, z; copy 0 is the reference) are copies under the named group. Spark sums moments by
    copy; the rest is small matrices. If copies don't lie as the group orders them and are at most so many, other orders are
    tried."""
    rotations = group(name)
    first = points.where("copy = 0").select("id", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    pairs = points.where("copy <> 0").select("copy", "id", *[F.col(c).alias(f"b{c}") for c in "xyz"]).join(first, "id")
    found = {r["copy"]: Moments.of(r) for r in moments(pairs, ["copy"]).collect()}  # a row for each copy
    if len(found) != len(rotations) - 1:
        raise ValueError(f"{name} has {len(rotations)} copies, not {len(found) + 1}")
    names = sorted(found)
    own = [found[k] for k in names]
    turns, shifts = map(list, zip(*(m.best() for m in own), strict=True))
    mean = own[0].a / own[0].n
    best = None
    for order in itertools.permutations(range(len(own))):
        tried = _fitted(own, turns, shifts, rotations, list(order), mean)
        best = tried if best is None or tried.rms < best.rms else best
        if best.rms <= accept or len(own) + 1 > most:
            break
    best.order = [names[k] for k in best.order]
    return best
