"""Registered queries: displaced volume, grid surfaces, fits over several parameters, symmetric assemblies, hydration."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.operators import excluded_volume, hydration, pairs, profiles, symmetry
from pointmill.plans import parameter_fit, profile_fit
from pointmill.plans.inputs import POINTS, points
from pointmill.plans.queries import _D, _FACTORS, _HIST, _PARTIAL, _SINC, query, rounded

#: Displaced volume by category, for the queries here.
_VOLUMES = ((0, 10.0), (1, 15.0), (2, 20.0))
_DENSITY = 0.334

_BY_PAIR = (
    f"{POINTS}, pr AS (SELECT least(a.body % 3, b.body % 3) AS ff_a, greatest(a.body % 3, b.body % 3) AS ff_b, {_D} AS d FROM p a JOIN p b ON a.id < b.id), "
    "h AS (SELECT ff_a, ff_b, bin, sum(c) AS value, sum(c)::BIGINT AS cnt, sum(s) AS dsum FROM (SELECT ff_a, ff_b, floor(d * 4 + 0.5)::BIGINT AS bin, (count(*) * 2)::DOUBLE AS c, sum(d) * 2 AS s FROM pr GROUP BY ALL UNION ALL SELECT body % 3, body % 3, 0, count(*)::DOUBLE, 0 FROM p GROUP BY ALL) GROUP BY ALL)"
)
_TERMS = (
    f"{_BY_PAIR}, q AS (SELECT i * 0.05::DOUBLE AS q FROM range(1, 11) t(i)), f(ff, a, b) AS (VALUES {', '.join(map(str, _FACTORS))}), vol(ff, v) AS (VALUES {', '.join(map(str, _VOLUMES))}), "
    f"i AS (SELECT q, ff_a, ff_b, sum(value * ({_SINC})) AS intensity FROM q, (SELECT ff_a, ff_b, value, dsum / cnt AS d FROM h) GROUP BY ALL), "
    f"own AS (SELECT ff, q, a * exp(-b * q * q) + 1.0 AS f, {_DENSITY} * v::DOUBLE * exp(-pow(v::DOUBLE, 2.0 / 3) / (4 * pi()) * q * q) AS x FROM f JOIN vol USING (ff), q)"
)
_JOINED = "FROM i JOIN {0} s ON ff_a = s.ff AND i.q = s.q JOIN {0} t ON ff_b = t.ff AND i.q = t.q GROUP BY i.q"


def _by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_histogram(points(spark, sf_dir).withColumn("ff", F.col("body") % 3).withColumn("w", F.lit(1.0)), ["ff"])


def _factors(spark: SparkSession, q: DataFrame) -> DataFrame:
    rows = [(f, a, b, v) for (f, a, b), (_, v) in zip(_FACTORS, _VOLUMES, strict=True)]
    table = spark.createDataFrame(rows, "ff long, a double, b double, v double").join(F.broadcast(q))
    return table.select("ff", "q", (F.col("a") * F.exp(-F.col("b") * F.col("q") * F.col("q")) + 1.0).alias("f"), profiles.volume_form_factor(F.col("q"), F.col("v"), _DENSITY).alias("x"))


def _terms(spark: SparkSession, sf_dir: str, average: bool = False) -> DataFrame:
    q = spark.range(1, 11).select((F.col("id") * 0.05).alias("q"))
    factors = _factors(spark, q)
    if average:
        factors = excluded_volume.averaged(factors, points(spark, sf_dir).groupBy((F.col("body") % 3).alias("ff")).agg(F.count(F.lit(1)).alias("n")))
    return excluded_volume.terms(profiles.transform(_by_pair(spark, sf_dir), q, ["ff_a", "ff_b"], enveloped=False), factors)


@query(f"WITH {_TERMS} SELECT round(i.q, 10) AS q, round(sum(intensity * s.f * t.f), 2) AS aa, round(sum(intensity * (s.f * t.x + s.x * t.f)), 2) AS ax, round(sum(intensity * s.x * t.x), 2) AS xx {_JOINED.format('own')}")
def exv_terms_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom with atom, atom with volume, volume with volume, each category displacing its own volume."""
    return rounded(_terms(spark, sf_dir), {"q": 10, "aa": 2, "ax": 2, "xx": 2})


_AVERAGE = "n AS (SELECT body % 3 AS ff, count(*) AS n FROM p GROUP BY 1), m AS (SELECT q, sum(x * n) / sum(n) AS x FROM own JOIN n USING (ff) GROUP BY q), avgd AS (SELECT own.ff, own.q, own.f, m.x FROM own JOIN m ON own.q = m.q)"


@query(f"WITH {_TERMS}, {_AVERAGE} SELECT round(i.q, 10) AS q, round(sum(intensity * s.f * t.f) - 1.05::DOUBLE * sum(intensity * (s.f * t.x + s.x * t.f)) + 1.1025::DOUBLE * sum(intensity * s.x * t.x), 2) AS intensity {_JOINED.format('avgd')}")
def exv_profile_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile with the mean volume for all, scaled by 1.05."""
    return rounded(excluded_volume.profile(_terms(spark, sf_dir, True), 1.05), {"q": 10, "intensity": 2})


_ORDERED = "SELECT 'ax' AS term, ff_a, ff_b, bin, CASE WHEN ff_a = ff_b THEN value ELSE value / 2 END AS value FROM h UNION ALL SELECT 'ax', ff_b, ff_a, bin, value / 2 FROM h WHERE ff_a <> ff_b"


@query(f"WITH {_BY_PAIR} SELECT 'aa' AS term, ff_a, ff_b, bin, value FROM h UNION ALL SELECT 'xx', ff_a, ff_b, bin, value FROM h UNION ALL SELECT term, ff_a, ff_b, bin, sum(value) AS value FROM ({_ORDERED}) GROUP BY ALL")
def exv_histograms_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excluded_volume.histograms(_by_pair(spark, sf_dir))


@query(f"WITH {_BY_PAIR} SELECT 'aa' AS term, ff_a, ff_b, bin, value FROM h UNION ALL SELECT 'xx', -1, -1, bin, sum(value) FROM h GROUP BY bin UNION ALL SELECT term, ff_a, -1, bin, sum(value) AS value FROM ({_ORDERED}) GROUP BY term, ff_a, bin")
def exv_histograms_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excluded_volume.histograms(_by_pair(spark, sf_dir), average=True)


@query(f"{_PARTIAL.replace('CASE label WHEN 0 THEN', 'CASE label % 3 WHEN 0 THEN')} SELECT round(q, 10) AS q, round(sum(CASE kind WHEN 'ww' THEN 1.44::DOUBLE WHEN 'aw' THEN 1.2::DOUBLE ELSE 1 END * intensity), 1) AS intensity FROM i WHERE kind NOT LIKE '%x%' GROUP BY q")
def grid_surface_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the interior (a) and of the surface (w), surface weights scaled by 1.2: ii + c is + c^2 ss."""
    p = points(spark, sf_dir).withColumn("kind", F.when(F.col("body") % 3 == 0, "w").when(F.col("body") == 9, "x").otherwise("a")).where("body <> 9 OR kind = 'w'")
    wide = profile_fit.partial_profiles(p.where("kind <> 'x'")).groupBy("q").agg(*[F.sum(F.when(F.col("kind") == k, F.col("intensity")).otherwise(0.0)).alias(k) for k in ("aa", "aw", "ww")])
    return rounded(wide.select("q", profiles.surface_total(F.col("aa"), F.col("aw"), F.col("ww"), 1.2).alias("intensity")), {"q": 10, "intensity": 1})


_GRID = [(w, c) for w in (0.0, 0.25, 0.5, 0.75, 1.0) for c in (0.92, 0.96, 1.0, 1.04, 1.08)]
_SUM = "aa - {1} * ax + {0} * aw + {1} * {1} * xx - {0} * {1} * wx + {0} * {0} * ww"


@query(
    f"{_PARTIAL}, t AS (SELECT q AS x, {', '.join(f'coalesce(sum(intensity) FILTER (kind = {chr(39)}{k}{chr(39)}), 0) AS {k}' for k in parameter_fit.TERMS)} FROM i GROUP BY q), "
    f"d AS (SELECT *, {_SUM.format('0.5::DOUBLE', '1.04::DOUBLE')} AS y FROM t), g(water, exv) AS (VALUES {', '.join(f'({w}::DOUBLE, {c}::DOUBLE)' for w, c in _GRID)}), "
    f"m AS (SELECT water, exv, y, 1 / pow(1000.0::DOUBLE, 2) AS v, {_SUM.format('water', 'exv')} AS m FROM d, g), "
    "z AS (SELECT water, exv, sum(v * m) / sum(v) AS m0, sum(v * y) / sum(v) AS y0 FROM m GROUP BY ALL), "
    "l AS (SELECT water, exv, m0, y0, sum(v * (m - m0) * (y - y0)) / sum(v * (m - m0) * (m - m0)) AS a FROM m JOIN z USING (water, exv) GROUP BY ALL) "
    "SELECT water, exv, round(any_value(a), 6) AS a, round(sum(v * pow((y - y0) - a * (m - m0), 2)), 3) AS chi2, count(*) AS n FROM m JOIN l USING (water, exv) GROUP BY water, exv"
)
def parameter_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goodness of fit over water and volume scales, scale and offset in closed form at each."""
    wide = parameter_fit.terms(points(spark, sf_dir)).withColumnRenamed("q", "x")
    known = {"water": F.lit(0.5), "exv": F.lit(1.04), "debye_waller": F.lit(0.0)}
    data = wide.withColumns({"y": parameter_fit.model(F.col("x"), known), "yerr": F.lit(1000.0)})
    found = parameter_fit.landscape(data, [{"water": w, "exv": c, "debye_waller": 0.0} for w, c in _GRID])
    return rounded(found.select("water", "exv", "a", "chi2", "n"), {"a": 6, "chi2": 3})


_SEEN = [1e-4 + k * ((1 - 1e-4) / 200) for k in (0, 7, 50, 98)] + [0.6, 0.75]


@query(f"WITH {POINTS}, {_HIST}, q(q) AS (VALUES {', '.join(f'({v!r}::DOUBLE)' for v in _SEEN)}) SELECT round(q, 10) AS q, round(sum(value * ({_SINC})) * exp(-q * q), 1) AS intensity FROM q, (SELECT value, dsum / cnt AS d FROM h WHERE cnt > 0) GROUP BY q.q")
def debye_at_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked q inside the default axis (by its spline, at knots here) and beyond it (by the kernel)."""
    q = spark.createDataFrame([(v,) for v in _SEEN], "q double")
    return rounded(profiles.transform_at(pairs.pair_histogram(points(spark, sf_dir)), q), {"q": 10, "intensity": 1})


_TURNS = [(k, cos(2 * pi * k / 3), sin(2 * pi * k / 3)) for k in range(3)]


@query(
    f"WITH {POINTS}, t(copy, c, s) AS (VALUES {', '.join(f'({k}, {c!r}, {s!r})' for k, c, s in _TURNS)}), m AS (SELECT copy * 1000000000 + id AS id, c * x - s * y AS x, s * x + c * y AS y, z, w FROM p, t), "
    f"pr AS (SELECT a.w * b.w AS v, {_D} AS d FROM m a JOIN m b ON a.id < b.id) "
    "SELECT floor(bin / 4)::BIGINT AS bin4, sum(value) AS value, sum(cnt)::BIGINT AS cnt, round(sum(dsum), 2) AS dsum FROM (SELECT floor(d * 4 + 0.5)::BIGINT AS bin, sum(v) * 2 AS value, count(*) * 2 AS cnt, sum(d) * 2 AS dsum FROM pr GROUP BY 1 UNION ALL SELECT 0, sum(w * w), count(*), 0 FROM m) GROUP BY 1"
)
def symmetric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points under c3, from the scheduled pairs of copies; rolled up to unit bins."""
    h = symmetry.histogram(points(spark, sf_dir), symmetry.group("c3"))
    return rounded(h.groupBy(F.floor(F.col("bin") / 4).alias("bin4")).agg(F.sum("value").alias("value"), F.sum("cnt").alias("cnt"), F.sum("dsum").alias("dsum")), {"dsum": 2})


_PLACED = (
    f"WITH RECURSIVE {POINTS}, o(a, b, c) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)), n AS (SELECT DISTINCT id AS of, x + a * 3 AS x, y + b * 3 AS y, z + c * 3 AS z FROM p, o), "
    "s AS (SELECT of, n.x, n.y, n.z, count(*) FILTER (pow(p.x - n.x, 2) + pow(p.y - n.y, 2) + pow(p.z - n.z, 2) <= 25) AS score, min(pow(p.x - n.x, 2) + pow(p.y - n.y, 2) + pow(p.z - n.z, 2)) AS near FROM n, p GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (ORDER BY score DESC, of, x, y, z) AS o FROM s WHERE near >= 6.25), "
    "e AS (SELECT a.o AS better, b.o AS worse FROM r a JOIN r b ON a.o < b.o AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) < 4), "
    # one water after another, in order: the first that no placed one is near to
    "g(o, placed) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT nxt, list_append(placed, nxt) FROM (SELECT placed, (SELECT min(r.o) FROM r WHERE r.o > g.o AND NOT EXISTS (SELECT 1 FROM e WHERE e.worse = r.o AND list_contains(placed, e.better))) AS nxt FROM g) WHERE nxt IS NOT NULL AND len(placed) < {limit}), "
    "k AS (SELECT r.* FROM r JOIN (SELECT unnest(placed) AS o FROM (SELECT placed FROM g ORDER BY len(placed) DESC LIMIT 1)) USING (o)) "
)


@query(_PLACED.replace("{limit}", "60") + "SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, 10.0::DOUBLE AS w FROM k")
def hydrated_waters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty waters that generating, clearing, scoring, placing apart and culling attach."""
    p = points(spark, sf_dir)
    made = hydration.hydrate(p, waters=60)
    return rounded(made.where("kind = 'w' AND body IS NULL").select("x", "y", "z", "w"), dict.fromkeys("xyz", 6))
