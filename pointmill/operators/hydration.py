"""Waters around points: candidate places on the grid next to filled voxels, and which of them stay.

A placed water takes its place from the others: of all candidates the best stays, those too near to it go, then the best of
the rest, and so on. That is done in rounds over the pairs of candidates that are too near: in each, all candidates without a
better one near them stay, and their worse neighbours go. The result is that of going through them one by one. A round is a
few joins of such pairs; there are about as many rounds as the logarithm of the candidates, and as the longest chain of
candidates that each beat the next at worst. The pairs of a candidate are bounded by how closely points can lie."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.operators.grid_volume import directions as all_directions
from pointmill.operators.voxels import _SIDES, expand
from pointmill.ordered import first_rows
from pointmill.stored import stored

#: Fixed value: the share of the greatest radial score that a candidate must exceed.
MIN_SCORE = 0.1


def target(radius_of_gyration: float, level: float = 0.01) -> float:
    """How many waters a shell about a body of this size holds: level 4 pi r^2.5."""
    return level * 4 * pi * radius_of_gyration**2.5


def along_axes(points: DataFrame, shell: float) -> DataFrame:
    """Six candidates for each point, shell away along the axes."""
    offsets = F.array(*[F.struct(*[F.lit(float(v) * shell).alias(n) for v, n in zip(s, "abc", strict=True)]) for s in _SIDES])
    return points.select("id", F.explode(offsets).alias("o"), "x", "y", "z").select(F.col("id").alias("of"), *[(F.col(c) + F.col(f"o.{n}")).alias(c) for c, n in zip("xyz", "abc", strict=True)])


def in_directions(points: DataFrame, shell: float, directions: list[tuple[float, float, float]]) -> DataFrame:
    """A candidate for each point and unit direction."""
    unit = F.array(*[F.struct(*[F.lit(v * shell).alias(n) for v, n in zip(d, "abc", strict=True)]) for d in directions])
    return points.select("id", F.explode(unit).alias("o"), "x", "y", "z").select(F.col("id").alias("of"), *[(F.col(c) + F.col(f"o.{n}")).alias(c) for c, n in zip("xyz", "abc", strict=True)])


def free(candidates: DataFrame, points: DataFrame, clearance: float) -> DataFrame:
    """Candidates with no point nearer than clearance. Space is cut into cells of that width: a candidate meets only the
    points of its own and the 26 cells around, by an equi-join."""
    def cell(c):
        return F.floor(F.col(c) / clearance)

    offset = F.explode(F.array(*[F.lit(v) for v in (-1, 0, 1)]))
    marked = candidates.withColumn("__id", F.xxhash64("of", "x", "y", "z"))
    near = points.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), *[cell(c).alias(f"p{n}") for c, n in zip("xyz", "abc", strict=True)])
    spread = marked.select("__id", "x", "y", "z", *[cell(c).alias(n) for c, n in zip("xyz", "abc", strict=True)]).withColumn("da", offset).withColumn("db", offset).withColumn("dc", offset)
    met = spread.join(near, (F.col("a") + F.col("da") == F.col("pa")) & (F.col("b") + F.col("db") == F.col("pb")) & (F.col("c") + F.col("dc") == F.col("pc")))
    close = met.where(sum(((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"), F.lit(0.0)) < clearance * clearance).select("__id").distinct()
    return marked.join(close, "__id", "left_anti").drop("__id")


def shell_voxels(voxels: DataFrame, inner: float, outer: float, cell: float = 1.0) -> DataFrame:
    """Voxels farther than inner and within outer of a filled one."""
    return expand(voxels, outer, cell).join(expand(voxels, inner, cell), ["i", "j", "k"], "left_anti")


def neighbour_voxels(voxels: DataFrame, steps: int) -> DataFrame:
    """Empty voxels steps away from a filled one along an axis."""
    offsets = F.array(*[F.struct(*[F.lit(v * steps).alias(n) for v, n in zip(s, "abc", strict=True)]) for s in _SIDES])
    made = voxels.select("i", "j", "k").distinct().withColumn("o", F.explode(offsets)).select(*[(F.col(n) + F.col(f"o.{m}")).alias(n) for n, m in zip("ijk", "abc", strict=True)]).distinct()
    return made.join(voxels.select("i", "j", "k").distinct(), ["i", "j", "k"], "left_anti")


def contacts(candidates: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """candidates with score: how many points lie within reach of each, by the same cells as in free()."""

    def cell(c):
        return F.floor(F.col(c) / reach)

    offset = F.explode(F.array(*[F.lit(v) for v in (-1, 0, 1)]))
    near = points.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), *[cell(c).alias(f"p{n}") for c, n in zip("xyz", "abc", strict=True)])
    spread = candidates.select("of", "x", "y", "z", *[cell(c).alias(n) for c, n in zip("xyz", "abc", strict=True)]).withColumn("da", offset).withColumn("db", offset).withColumn("dc", offset)
    met = spread.join(near, (F.col("a") + F.col("da") == F.col("pa")) & (F.col("b") + F.col("db") == F.col("pb")) & (F.col("c") + F.col("dc") == F.col("pc")), "left")
    close = sum(((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"), F.lit(0.0)) <= reach * reach
    return met.groupBy("of", "x", "y", "z").agg(F.count_if(F.coalesce(close, F.lit(False))).alias("score"))


def noisy(candidates: DataFrame, width: float, seed: int = 42) -> DataFrame:
    """candidates moved by normal noise on each axis. The noise follows from the place and the seed alone, so that a task that
    runs again gives the same."""

    def uniform(n: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "of", "x", "y", "z"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))

    def normal(n: int) -> Column:
        return F.sqrt(-2 * F.log(uniform(2 * n))) * F.cos(2 * pi * uniform(2 * n + 1))

    return candidates.withColumns({c: F.col(c) + width * normal(n) for n, c in enumerate("xyz")})


def radial_scores(candidates: DataFrame, voxels: DataFrame, low: tuple[float, float, float], bins: tuple[int, int, int], radius: float, cell: float = 1.0, divisions: int = 8) -> DataFrame:
    """candidates with blocked (directions in which the voxel at radius is filled) and score.

    A direction that isn't blocked counts 2 if the voxel at three radii is empty or outside the grid (of bins cells from low
    on), else -2; if it is empty and inside, the voxel at five radii counts 1 outside and -1 filled. Each candidate asks the
    voxels about it with masks of directions, which meet filled ones in one join and are or-ed."""
    ways = all_directions(divisions)
    if len(ways) > 63:
        raise ValueError("at most 63 directions")

    def whole(v: float) -> int:
        return int(abs(v) + 0.5) * (1 if v >= 0 else -1)

    asked: dict[tuple[int, int, int], list[int]] = {}
    steps = [[tuple(int(whole(round(r * c, 9)) / cell) for c in way) for way in ways] for r in (radius, 3 * radius, 5 * radius)]
    for ring, places in enumerate(steps):
        for way, at in enumerate(places):
            if ring:
                asked.setdefault(at, [0, 0, 0])[ring] |= 1 << way
    named = candidates.withColumn("__c", F.xxhash64("of", "x", "y", "z"))
    at = [F.floor((F.col(c) - lo) / cell + 0.5).cast("long").alias(n) for c, lo, n in zip("xyz", low, "ijk", strict=True)]
    centres = stored(named.select("__c", *at))

    def masks(ring: int, n: int) -> Column:
        """Directions whose voxel lies outside on one axis."""
        own = F.lit(0).cast("long")
        for way, place in enumerate(steps[ring]):
            v = F.col("ijk"[n]) + place[n]
            own = own.bitwiseOR(F.when((v < 0) | (v >= bins[n]), F.lit(1 << way)).otherwise(F.lit(0)).cast("long"))
        return own

    # those at one radius are clamped to the grid
    first = F.array(*[F.struct(*[F.greatest(F.lit(0), F.least(F.lit(b - 1), F.col(n) + place[k])).cast("long").alias(n) for k, (n, b) in enumerate(zip("ijk", bins, strict=True))], F.lit(1 << way).cast("long").alias("m1"), F.lit(0).cast("long").alias("m3"), F.lit(0).cast("long").alias("m5")) for way, place in enumerate(steps[0])])
    others = F.array(*[F.struct(*[(F.col(n) + place[k]).cast("long").alias(n) for k, n in enumerate("ijk")], F.lit(0).cast("long").alias("m1"), F.lit(own[1]).cast("long").alias("m3"), F.lit(own[2]).cast("long").alias("m5")) for place, own in asked.items()])
    filled = voxels.select("i", "j", "k").distinct()
    looks = centres.select("__c", F.explode(F.concat(first, others)).alias("a")).select("__c", "a.*")
    hits = looks.join(filled, ["i", "j", "k"]).groupBy("__c").agg(*[F.bit_or(m).alias(m) for m in ("m1", "m3", "m5")])
    nothing = F.lit(0).cast("long")
    m1, m3, m5 = (F.coalesce(m, nothing) for m in ("m1", "m3", "m5"))
    out3, out5 = (masks(r, 0).bitwiseOR(masks(r, 1)).bitwiseOR(masks(r, 2)) for r in (1, 2))
    every = F.lit((1 << len(ways)) - 1).cast("long")
    judged = centres.withColumns({"o3": out3, "o5": out5}).join(hits, "__c", "left").withColumns({"m1": m1, "m3": m3, "m5": m5})
    c = F.col
    clear = every.bitwiseAND(F.bitwise_not(c("m1")))
    stopped = clear.bitwiseAND(c("m3")).bitwiseAND(F.bitwise_not(c("o3")))
    on = clear.bitwiseAND(F.bitwise_not(c("m3"))).bitwiseAND(F.bitwise_not(c("o3")))
    far = F.bit_count(on.bitwiseAND(c("o5"))) - F.bit_count(on.bitwiseAND(c("m5")).bitwiseAND(F.bitwise_not(c("o5"))))
    score = 2 * F.bit_count(clear) - 4 * F.bit_count(stopped) + far
    scores = judged.select("__c", F.bit_count("m1").cast("long").alias("blocked"), score.cast("long").alias("score")).dropDuplicates(["__c"])
    return named.join(scores, "__c").drop("__c")


def radially_free(scored: DataFrame, divisions: int = 8, least: float = MIN_SCORE) -> DataFrame:
    """Candidates blocked in two directions at most whose score exceeds least of three a direction."""
    return scored.where((F.col("blocked") <= 2) & (F.col("score") > least * 3 * len(all_directions(divisions))))


def spaced(scored: DataFrame, spacing: float, within: list[str] | None = None) -> DataFrame:
    """Candidates of which no two lie nearer than spacing: of those too near each other the one of most score stays (of equal
    ones the least of, x, y, z), as if they were placed one by one in that order. Rows equal in all are one candidate. Those
    that differ in a column of within don't see each other; all groups are gone through together."""
    groups = within or []
    node = [*groups, "of", "x", "y", "z"]
    nodes = stored(scored.dropDuplicates(node).withColumn("__n", F.xxhash64(*node)))
    offset = F.explode(F.array(*[F.lit(v) for v in (-1, 0, 1)]))
    cells = [F.floor(F.col(c) / spacing).alias(n) for c, n in zip("xyz", "abc", strict=True)]
    rank = F.struct((-F.col("score")).alias("s"), "of", "x", "y", "z").alias("r")
    placed = nodes.select(F.col("__n").alias("n"), rank, *cells, *groups)
    spread = placed.withColumns({"da": offset}).withColumns({"db": offset}).withColumns({"dc": offset}).select(F.col("n").alias("worse"), F.col("r").alias("q"), *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in "abc"], *groups)
    near = sum(((F.col(f"r.{c}") - F.col(f"q.{c}")) ** 2 for c in "xyz"), F.lit(0.0)) < spacing * spacing
    edges = stored(placed.join(spread, ["a", "b", "c", *groups]).where(near & (F.col("r") < F.col("q"))).select(F.col("n").alias("better"), "worse"))
    gone: DataFrame | None = None
    while not edges.isEmpty():
        beaten = edges.select(F.col("worse").alias("better")).distinct()
        best = edges.select("better").distinct().join(beaten, "better", "left_anti")
        losers = stored(edges.join(best, "better", "left_semi").select("worse").distinct())
        gone = losers if gone is None else gone.union(losers)
        edges = stored(edges.join(losers, "worse", "left_anti").join(losers.select(F.col("worse").alias("better")), "better", "left_anti"))
    kept = nodes if gone is None else nodes.join(gone.select(F.col("worse").alias("__n")), "__n", "left_anti")
    return kept.drop("__n")


def generate(points: DataFrame, strategy: str = "axes", shell: float = 3.0, clearance: float = 2.5, reach: float = 5.0, directions: list[tuple[float, float, float]] | None = None, cell: float = 1.0, radius: float = 1.5, core: float = 1.0, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """of, x, y, z, score of the candidates of a strategy: axes (or given directions; scored by contacts), radial (in all
    directions, kept and scored by rays from the candidate, which points block within core), none."""
    if strategy == "none":
        return contacts(along_axes(points, shell).where("false"), points, reach)
    if strategy == "axes":
        made = in_directions(points, shell, directions) if directions else along_axes(points, shell)
        return contacts(free(made, points, clearance), points, reach)
    if strategy != "radial":
        raise ValueError(f"unknown strategy {strategy}: axes, radial or none")
    made = in_directions(points, shell, directions or all_directions())
    made = free(noisy(made, noise, seed) if noise else made, points, clearance)
    box = points.agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if box["x_lo"] is None:
        return contacts(made, points, reach)
    margin = 2 * shell  # the grid reaches beyond the points by two shells
    low = tuple(box[f"{c}_lo"] - margin for c in "xyz")
    bins = tuple(int((box[f"{c}_hi"] + margin - lo) / cell + 0.5) + 1 for c, lo in zip("xyz", low, strict=True))
    taken = points.select(*[F.floor((F.col(c) - lo) / cell + 0.5).cast("long").alias(n) for c, lo, n in zip("xyz", low, "ijk", strict=True)])
    scored = radial_scores(made, expand(taken, core, cell), low, bins, radius, cell)
    return radially_free(scored).drop("blocked")


def hydrate(points: DataFrame, shell: float = 3.0, clearance: float = 2.5, reach: float = 5.0, spacing: float = 2.0, waters: int | None = None, directions: list[tuple[float, float, float]] | None = None, weight: float = 10.0, strategy: str = "axes", noise: float = 0.0) -> DataFrame:
    """points with waters attached (kind w): candidates shell away along the axes (or directions, or radially), less those
    with a point nearer than clearance, so placed that none is nearer to another than spacing, and culled to so many of
    highest score (all that a shell about a body of this size holds, unless given; see target)."""
    from pointmill.operators.mass import radius_of_gyration

    if waters is None:
        waters = int(target(radius_of_gyration(points).first()["rg"] or 0.0))
    placed = spaced(generate(points, strategy, shell, clearance, reach, directions, noise=noise), spacing)
    kept = first_rows(placed, [F.desc("score"), F.asc("of"), F.asc("x"), F.asc("y"), F.asc("z")], waters)
    columns = {"id": F.xxhash64(F.lit("w"), "of", "x", "y", "z").cast(points.schema["id"].dataType), "w": F.lit(float(weight)), "kind": F.lit("w")}
    attached = kept.select(*[(columns[c] if c in columns else F.col(c) if c in "xyz" else F.lit(None).cast(points.schema[c].dataType)).alias(c) for c in points.columns])
    return points.unionByName(attached)
