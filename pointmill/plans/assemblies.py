"""Registered queries: assemblies with shared symmetries, and grids that change."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.operators import grid_state
from pointmill.plans.inputs import POINTS, points
from pointmill.plans.queries import _D, query, rounded
from pointmill.stored import stored
from pointmill.streaming import symmetric

#: Bodies 1 and 2 share a threefold axis, body 3 has one of its own, which changes; the others stand alone.
_GROUPS = {1: 12, 2: 12}
_BEFORE, _AFTER = {12: "c3", 3: "c2"}, {12: "c3", 3: "c4"}


def _members(p: DataFrame, kinds: dict[int, str]) -> DataFrame:
    of = F.when(F.col("body").isin(list(_GROUPS)), F.lit(12)).otherwise(F.col("body")).cast("long")
    kind = F.lit("c1")
    for key, name in kinds.items():
        kind = F.when(F.col("group") == key, name).otherwise(kind)
    return stored(p.select("body").distinct().withColumn("group", of).withColumn("kind", kind))  # a row for each body


def _turned(p: DataFrame) -> DataFrame:
    """The new state: body 1 has moved."""
    return p.withColumn("x", F.when(F.col("body") == 1, F.col("x") + 1.5).otherwise(F.col("x")))


def _turns(kind: str) -> list[tuple[int, float, float]]:
    n = int(kind[1:])
    return [(k, cos(2 * pi * k / n), sin(2 * pi * k / n)) for k in range(n)]


_COPIES = ", ".join(f"({g}, {k}, {c!r}::DOUBLE, {s!r}::DOUBLE)" for g, kind in _AFTER.items() for k, c, s in _turns(kind))
_ASSEMBLY = (
    f"WITH {POINTS}, u AS (SELECT * REPLACE (CASE body WHEN 1 THEN x + 1.5 ELSE x END AS x), CASE WHEN body IN (1, 2) THEN 12 ELSE body END AS grp FROM p), "
    "ctr AS (SELECT grp, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy FROM u GROUP BY grp), "
    f"t(grp, copy, c, s) AS (VALUES {_COPIES}), "
    "m AS (SELECT u.id + 1000000000::BIGINT * coalesce(copy, 0) AS id, CASE WHEN copy IS NULL THEN x ELSE cx + c * (x - cx) - s * (y - cy) END AS x, CASE WHEN copy IS NULL THEN y ELSE cy + s * (x - cx) + c * (y - cy) END AS y, z, w "
    "FROM u JOIN ctr USING (grp) LEFT JOIN t USING (grp)), "
    f"pr AS (SELECT a.w * b.w AS v, {_D} AS d FROM m a JOIN m b ON a.id < b.id) "
    "SELECT floor(bin / 4)::BIGINT AS bin4, sum(value) AS value, sum(cnt)::BIGINT AS cnt, round(sum(dsum), 2) AS dsum FROM (SELECT floor(d * 4 + 0.5)::BIGINT AS bin, sum(v) * 2 AS value, count(*) * 2 AS cnt, sum(d) * 2 AS dsum FROM pr GROUP BY 1 UNION ALL SELECT 0, sum(w * w), count(*), 0 FROM m) GROUP BY 1"
)


@query(_ASSEMBLY)
def symmetric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assembly after a body of a shared symmetry has moved and another's symmetry has changed, by delta from the state
    before; rolled up to unit bins."""
    p = points(spark, sf_dir)
    before, after = _members(p, _BEFORE), _members(p, _AFTER)
    partial = stored(symmetric.by_copy_pairs(p, before, symmetric.schedule(before)))
    bodies, groups = spark.createDataFrame([(1,)], "body long"), spark.createDataFrame([(3,)], "group long")
    now = symmetric.update(partial, _turned(p), after, bodies, groups)
    h = symmetric.assembly(now, after)
    return rounded(h.groupBy(F.floor(F.col("bin") / 4).alias("bin4")).agg(F.sum("value").alias("value"), F.sum("cnt").alias("cnt"), F.sum("dsum").alias("dsum")), {"dsum": 2})


_ROLES = "(4, 0, 0), (8, 1, 1), (1, 2, 4)"
_GRID = (
    f"WITH {POINTS}, n AS (SELECT body, kind, floor(x + 40 + 0.5)::BIGINT AS i, floor(y + 40 + 0.5)::BIGINT AS j, floor(z + 40 + 0.5)::BIGINT AS k FROM p WHERE body <> 4), "
    "o AS (SELECT a.v AS a, b.v AS b, c.v AS c, a.v * a.v + b.v * b.v + c.v * c.v AS d FROM (SELECT unnest(range(-2, 3)) AS v) a, (SELECT unnest(range(-2, 3)) AS v) b, (SELECT unnest(range(-2, 3)) AS v) c), "
    f"r(role, lo, hi) AS (VALUES {_ROLES}), "
    "h AS (SELECT i + a AS i, j + b AS j, k + c AS k, CASE WHEN kind <> 'w' THEN role WHEN role = 4 THEN 16 ELSE 32 END AS role FROM n, o, r WHERE d BETWEEN lo AND hi AND (kind <> 'w' OR role <> 1)), "
    "s AS (SELECT i, j, k, bit_or(role) AS state FROM h GROUP BY ALL) SELECT state, count(*) AS voxels, sum(i + 2 * j + 3 * k)::BIGINT AS places FROM s GROUP BY state"
)


@query(_GRID)
def grid_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels by state once bodies were added one after another and one (body 4) was taken away again."""
    p = points(spark, sf_dir)

    def part(condition: str) -> DataFrame:
        return grid_state.contributions(p.where(condition), (-40.0, -40.0, -40.0))

    grid = grid_state.add(grid_state.add(part("body < 4"), part("body = 4")), part("body > 4"))
    grid = grid_state.take_away(grid, part("body = 4"))
    found = grid_state.states(grid)
    return found.groupBy("state").agg(F.count(F.lit(1)).alias("voxels"), F.sum(F.col("i") + 2 * F.col("j") + 3 * F.col("k")).alias("places"))
