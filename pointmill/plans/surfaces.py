"""Registered queries: surfaces by rays, displaced volume on a grid, categories and their volumes, moves of groups, scans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.operators import categories, density_map, fitting, grid_volume, map_fit, map_water, pairs, profiles, rigid, symmetry, voxels
from pointmill.plans import profile_fit
from pointmill.plans.inputs import POINTS, SERIES, points, series
from pointmill.plans.queries import _D, _FACTORS, _GROWN, _HIGH, _LEVELS, _LOW, _MAP, _SINC, _map, query, rounded, significant, voxel_expand
from pointmill.stored import stored

_RAYS = 26
_RAY_ROWS = ", ".join(map(str, grid_volume.ray_steps()))
_MARKED = (
    f"{_GROWN}, o(ray, step, a, b, c) AS (VALUES {_RAY_ROWS}), met AS (SELECT g.i, g.j, g.k, ray, min(step) AS step FROM g JOIN o ON true JOIN g h ON h.i = g.i + a AND h.j = g.j + b AND h.k = g.k + c GROUP BY ALL), "
    f"sc AS (SELECT g.i, g.j, g.k, {_RAYS} * 7 - coalesce(lost, 0) AS score FROM g LEFT JOIN (SELECT i, j, k, sum(CASE step WHEN 1 THEN 7 WHEN 2 THEN 4 ELSE 2 END) AS lost FROM met GROUP BY ALL) USING (i, j, k))"
)


@query(f"{_MARKED} SELECT i, j, k, score::BIGINT AS score FROM sc")
def voxel_ray_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_volume.ray_scores(voxel_expand(spark, sf_dir))


@query(f"{_MARKED}, u AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k, true AS hit FROM sc, (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(a, b, c) WHERE score >= 42) SELECT i, j, k, hit IS NOT NULL AS surface FROM sc LEFT JOIN u USING (i, j, k)")
def voxel_ray_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels that enough rays leave, and those next to them: a surface two cells thick."""
    return grid_volume.surface_by_rays(voxel_expand(spark, sf_dir), thickness=2.0)


_WIDTH, _DENSITY = 4.0, 0.334
_ALL = (
    f"{_MARKED}, pts AS (SELECT id, x, y, z, (body % 3)::BIGINT AS ff FROM p UNION ALL SELECT -1 - row_number() OVER (ORDER BY i, j, k), lx + i, ly + j, lz + k, CASE WHEN score >= 42 THEN -2 ELSE -1 END FROM sc, b WHERE i % 4 = 0 AND j % 4 = 0 AND k % 4 = 0), "
    f"pr AS (SELECT least(a.ff, b.ff) AS ff_a, greatest(a.ff, b.ff) AS ff_b, {_D} AS d FROM pts a JOIN pts b ON a.id < b.id), "
    "h AS (SELECT ff_a, ff_b, bin, sum(c) AS value, sum(c)::BIGINT AS cnt, sum(s) AS dsum FROM (SELECT ff_a, ff_b, floor(d * 4 + 0.5)::BIGINT AS bin, (count(*) * 2)::DOUBLE AS c, sum(d) * 2 AS s FROM pr GROUP BY ALL UNION ALL SELECT ff, ff, 0, count(*)::DOUBLE, 0 FROM pts GROUP BY ALL) GROUP BY ALL)"
)


def _grid_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    low = voxels.bounding_box(p).first()  # one row
    cells = grid_volume.voxel_points(grid_volume.surface_by_rays(voxel_expand(spark, sf_dir)), tuple(low[f"{c}_min"] for c in "xyz"), width=_WIDTH)
    return grid_volume.histograms(p.withColumns({"ff": F.col("body") % 3, "w": F.lit(1.0)}), cells)


@query(f"{_ALL} SELECT ff_a, ff_b, bin, value, cnt, round(dsum, 3) AS dsum FROM h")
def grid_exv_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms by category, interior and surface of the grid, each with each."""
    return rounded(_grid_histograms(spark, sf_dir), {"dsum": 3})


_X = f"{_DENSITY}::DOUBLE * 64.0::DOUBLE * exp(-pow(64.0::DOUBLE, 2.0 / 3) / (4 * pi()) * q * q)"


@query(
    f"{_ALL}, q AS (SELECT r * 0.05::DOUBLE AS q FROM range(1, 11) t(r)), f(ff, a, b) AS (VALUES {', '.join(map(str, _FACTORS))}), own AS (SELECT ff, q, a * exp(-b * q * q) + 1.0 AS f FROM f, q UNION ALL SELECT u.ff, q, {_X} FROM (VALUES (-1), (-2)) u(ff), q), "
    f"pf AS (SELECT q, ff_a, ff_b, sum(value * ({_SINC})) AS intensity FROM q, (SELECT ff_a, ff_b, value, dsum / cnt AS d FROM h) GROUP BY ALL), "
    "t AS (SELECT pf.q, CASE WHEN ff_b >= 0 AND ff_a >= 0 THEN 'aa' WHEN ff_b >= 0 THEN CASE ff_a WHEN -1 THEN 'ai' ELSE 'as' END WHEN ff_a = -1 THEN 'ii' WHEN ff_b = -2 THEN 'ss' ELSE 'is' END AS kind, intensity * s.f * t.f AS v FROM pf JOIN own s ON ff_a = s.ff AND pf.q = s.q JOIN own t ON ff_b = t.ff AND pf.q = t.q) "
    "SELECT round(q, 10) AS q, round(sum(CASE kind WHEN 'aa' THEN 1 WHEN 'ai' THEN -0.98::DOUBLE WHEN 'as' THEN -0.98::DOUBLE * 1.2::DOUBLE WHEN 'ii' THEN 0.9604::DOUBLE WHEN 'is' THEN 0.9604::DOUBLE * 1.2::DOUBLE ELSE 0.9604::DOUBLE * 1.44::DOUBLE END * v), 1) AS intensity FROM t GROUP BY q"
)
def grid_exv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms less the grid's volume scaled by 0.98, that of its surface by 1.2 besides."""
    q = spark.range(1, 11).select((F.col("id") * 0.05).alias("q"))
    atoms = spark.createDataFrame([tuple(map(float, r)) for r in _FACTORS], "ff double, a double, b double").join(F.broadcast(q))
    own = atoms.select(F.col("ff").cast("long").alias("ff"), "q", (F.col("a") * F.exp(-F.col("b") * F.col("q") * F.col("q")) + 1.0).alias("f"))
    cells = q.select(F.explode(F.array(*[F.lit(c).cast("long") for c in (grid_volume.INTERIOR, grid_volume.SURFACE)])).alias("ff"), "q").withColumn("f", profiles.volume_form_factor(F.col("q"), _WIDTH**3, _DENSITY))
    by_pair = profiles.transform(_grid_histograms(spark, sf_dir), q, ["ff_a", "ff_b"], enveloped=False)
    return rounded(grid_volume.profile(grid_volume.terms(by_pair, own.unionByName(cells)), 0.98, 1.2), {"q": 10, "intensity": 1})


@query(f"WITH {POINTS}, pr AS (SELECT (a.body % 3 + 1) * (b.body % 3 + 1) AS v, {_D} AS d FROM p a JOIN p b ON a.id < b.id) SELECT bin, sum(v)::DOUBLE AS value FROM (SELECT floor(d * 4 + 0.5)::BIGINT AS bin, 2 * v AS v FROM pr UNION ALL SELECT 0, (body % 3 + 1) * (body % 3 + 1) FROM p) GROUP BY bin")
def weighted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = pairs.pair_histogram(points(spark, sf_dir).withColumns({"ff": F.col("body") % 3, "w": F.lit(1.0)}), ["ff"])
    return grid_volume.weighted_counts(h, spark.createDataFrame([(k, k + 1.0) for k in range(3)], "ff long, f double"))


_VOLUME_ROWS = ", ".join(f"('{c}', {v!r}::DOUBLE)" for c, v in zip(categories.CATEGORIES, categories.VOLUME_SETS[categories.DEFAULT_SET], strict=True))


@query(
    f"WITH {POINTS}, vol(category, v) AS (VALUES {_VOLUME_ROWS}), e AS (SELECT body, CASE body % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'N' WHEN 2 THEN 'O' ELSE 'FE' END AS element, id % 4 AS h FROM p), "
    "g AS (SELECT body, element, CASE h WHEN 0 THEN '' WHEN 1 THEN element || 'H' ELSE element || 'H' || h END AS grp FROM e), "
    "c AS (SELECT body, CASE WHEN len(grp) > 1 AND grp IN (SELECT category FROM vol) THEN grp WHEN element IN (SELECT category FROM vol) THEN element ELSE 'OTHER' END AS category FROM g) "
    "SELECT body, category, count(*) AS n, round(sum(coalesce(v, 0)), 3) AS volume, count(*) FILTER (v IS NULL) AS unknown FROM c LEFT JOIN vol USING (category) GROUP BY ALL"
)
def displaced_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories from element and hydrogens, and the volumes that they displace by body."""
    k = F.col("body") % 4
    p = points(spark, sf_dir).withColumn("element", F.when(k == 0, "C").when(k == 1, "N").when(k == 2, "O").otherwise("FE"))
    own = p.withColumn("category", categories.category(F.col("element"), F.coalesce(categories.group_of(F.col("element"), F.col("id") % 4), F.lit(""))))
    return rounded(categories.displaced(own, categories.volumes(spark), ["body", "category"]), {"volume": 3})


_GROUPS = [((1, 4, 5), symmetry.rotation((0, 0, 1), 0.5), (1.0, 0.0, 0.0)), ((2,), symmetry.rotation((1, 0, 0), -0.25), (0.0, 2.0, 0.0))]
_GROUP_ROWS = ", ".join(f"({k}, {list(b)}, {', '.join(repr(float(v)) for v in r.ravel())}, {', '.join(map(repr, t))})" for k, (b, r, t) in enumerate(_GROUPS))
_IN = "list_contains(moving, body)"


@query(
    f"WITH {POINTS}, m(move, moving, r00, r01, r02, r10, r11, r12, r20, r21, r22, t0, t1, t2) AS (VALUES {_GROUP_ROWS}), "
    f"v AS (SELECT move, id, w, CASE WHEN {_IN} THEN r00 * x + r01 * y + r02 * z + t0 ELSE x END AS x, CASE WHEN {_IN} THEN r10 * x + r11 * y + r12 * z + t1 ELSE y END AS y, CASE WHEN {_IN} THEN r20 * x + r21 * y + r22 * z + t2 ELSE z END AS z FROM p, m), "
    f"pr AS (SELECT a.move, a.w * b.w AS v, {_D} AS d FROM v a JOIN v b ON a.move = b.move AND a.id < b.id) "
    "SELECT move, bin, sum(value) AS value, sum(cnt)::BIGINT AS cnt, round(sum(dsum), 3) AS dsum FROM (SELECT move, floor(d * 4 + 0.5)::BIGINT AS bin, sum(v) * 2 AS value, count(*) * 2 AS cnt, sum(d) * 2 AS dsum FROM pr GROUP BY ALL UNION ALL SELECT move, 0, sum(w * w), count(*), 0 FROM v GROUP BY move) GROUP BY ALL"
)
def group_move_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of a group of bodies and of one body, tried in one job."""
    return rounded(rigid.move_histograms(points(spark, sf_dir), [(b, r, np.array(t)) for b, r, t in _GROUPS]), {"dsum": 3})


_SCAN = f"{SERIES}, c AS (SELECT set_id, k * 10.0::DOUBLE AS p, sum(pow((y - k * 10.0::DOUBLE) / yerr, 2)) AS chi2 FROM s, range(0, 41) t(k) GROUP BY ALL)"


@query(
    f"WITH {_SCAN}, r AS (SELECT *, row_number() OVER d AS nth, min(chi2) OVER d AS least, avg(chi2) OVER (PARTITION BY set_id ORDER BY p DESC ROWS 6 PRECEDING) AS mean FROM c WINDOW d AS (PARTITION BY set_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), "
    "o AS (SELECT *, nth > 41 * 0.7::DOUBLE AND chi2 > 1.05::DOUBLE * least AND mean > 1.05::DOUBLE * least AS over FROM r), "
    "e AS (SELECT *, over AND lag(over) OVER (PARTITION BY set_id ORDER BY nth) AND lag(over, 2) OVER (PARTITION BY set_id ORDER BY nth) AS third FROM o), l AS (SELECT set_id, min(nth) AS last FROM e WHERE third GROUP BY 1) "
    "SELECT set_id, p, round(chi2, 3) AS chi2 FROM e LEFT JOIN l USING (set_id) WHERE nth <= coalesce(last, 41)"
)
def limited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan from above, given up where it only gets worse."""
    scan = fitting.grid_scan(series(spark, sf_dir), [10.0 * k for k in range(41)], lambda p: p, ["set_id"])
    return rounded(fitting.until_hopeless(scan, ["set_id"], 1.05), {"chi2": 3})


@query(f"WITH {_MAP} SELECT (x // 4)::INT AS x, (y // 4)::INT AS y, round(avg(val), 4) AS val FROM v WHERE z = 0 GROUP BY x // 4, y // 4")
def map_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density_map.image(_map(spark, sf_dir), 0, 4), {"val": 4})


@query()
def map_search_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cutoff of the voxels that gave the curve is searched from coarse to fine."""
    v = _map(spark, sf_dir)
    truth = map_fit.banded_points(v, 5, _LOW, _HIGH).where("band >= 3")
    found = map_fit.search_cutoff(v, profile_fit.simulate(truth, 40), _LOW, _HIGH, levels=5, rounds=1, most=1)
    return significant(spark.createDataFrame([(found.cutoff, found.chi2, found.low, found.high)], "cutoff double, chi2 double, low double, high double"), "chi2")


_BANDED = (
    f"{_MAP}, p AS (SELECT row_number() OVER (ORDER BY z, y, x) AS id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, CASE WHEN val >= {_HIGH} THEN {_LEVELS} + 1 ELSE floor((val - {_LOW}::DOUBLE) / ({_HIGH} - {_LOW})::DOUBLE * {_LEVELS})::INT + 1 END AS band FROM v WHERE val >= {_LOW})"
)
_PLACES = (
    f"{_BANDED}, o(a, b, c) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)), c AS (SELECT DISTINCT x + a * 3 AS x, y + b * 3 AS y, z + c * 3 AS z FROM p, o), "
    f"l AS (SELECT level, c.x, c.y, c.z, count(*) FILTER (pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2) <= 25) AS score, min(pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2)) AS near, "
    f"count(*) FILTER (abs(p.x - c.x) + abs(p.y - c.y) + abs(p.z - c.z) = 3 AND greatest(abs(p.x - c.x), abs(p.y - c.y), abs(p.z - c.z)) = 3) AS made FROM range(1, {_LEVELS + 1}) t(level), c, p WHERE p.band >= level GROUP BY ALL), "
    "f AS (SELECT level, x, y, z, score FROM l WHERE made > 0 AND near >= 6.25)"
)


@query(f"WITH {_PLACES} SELECT level::INT AS level, x, y, z, score FROM f")
def map_water_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The free places about the shape of each cutoff, all from one join."""
    return map_water.places(map_fit.banded_points(_map(spark, sf_dir), _LEVELS, _LOW, _HIGH), _LEVELS)


_W = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(
    f"WITH {_PLACES}, pr AS (SELECT level, 'aa' AS kind, {_W} AS d, 1.0::DOUBLE AS v FROM range(1, {_LEVELS + 1}) t(level), p a JOIN p b ON a.id < b.id WHERE least(a.band, b.band) >= level "
    f"UNION ALL SELECT a.level, 'aw', {_W}, 2 FROM f a JOIN p b ON b.band >= a.level UNION ALL SELECT a.level, 'ww', {_W}, 4 FROM f a JOIN f b ON a.level = b.level AND (a.x, a.y, a.z) < (b.x, b.y, b.z)), "
    "h AS (SELECT level, kind, floor(d * 4 + 0.5)::BIGINT AS bin, sum(v) * 2 AS value, count(*) * 2 AS cnt, sum(d) * 2 AS dsum FROM pr GROUP BY ALL "
    f"UNION ALL SELECT level, 'aa', 0, count(*), count(*), 0 FROM range(1, {_LEVELS + 1}) t(level), p WHERE band >= level GROUP BY level UNION ALL SELECT level, 'ww', 0, count(*) * 4, count(*), 0 FROM f GROUP BY level) "
    "SELECT level::INT AS level, kind, bin, sum(value)::DOUBLE AS value, sum(cnt)::BIGINT AS cnt, round(sum(dsum), 3) AS dsum FROM h GROUP BY ALL"
)
def map_water_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels and waters of weight 2 at all their free places: the histograms of all cutoffs from three joins."""
    p = map_fit.banded_points(_map(spark, sf_dir), _LEVELS, _LOW, _HIGH)
    placed = stored(map_water.places(p, _LEVELS).withColumn("w", F.lit(2.0)))
    return rounded(map_water.histograms(p, placed, _LEVELS), {"dsum": 3})


@query(
    f"WITH {_BANDED} SELECT level::INT AS level, {_LOW} + (level - 1) * (({_HIGH} - {_LOW}) / {_LEVELS})::DOUBLE AS cutoff, count(*) AS voxels, round(count(*) * 0.81::DOUBLE, 6) AS mass FROM range(1, {_LEVELS + 1}) t(level), p WHERE band >= level GROUP BY level"
)
def map_mass_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mass of what each cutoff leaves, from one count by band."""
    p = map_fit.banded_points(_map(spark, sf_dir), _LEVELS, _LOW, _HIGH)
    return rounded(map_water.masses(p, _LEVELS, _LOW, _HIGH), {"mass": 6})


@query()
def map_water_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve of the third cutoff's voxels with waters of weight 3 is fitted at every cutoff, waters placed about each
    shape anew: the third must win, with a factor of 3."""
    p = map_fit.banded_points(_map(spark, sf_dir), _LEVELS, _LOW, _HIGH)
    third = p.where("band >= 3")
    own = map_water.waters(third.withColumn("band", F.lit(1)), 1).select(F.xxhash64("x", "y", "z").alias("id"), "x", "y", "z", F.lit(3.0).alias("w"), F.lit("w").alias("kind"))
    truth = third.select("id", "x", "y", "z", "w", F.lit("a").alias("kind")).unionByName(own)
    fits = map_water.fit_cutoffs(p, profile_fit.simulate(truth, 40, by_kind=True), _LEVELS)
    return significant(rounded(fits, {"a": 4, "b": 2, "water": 4}), "chi2")
