"""Registered queries over the tables of a folder, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from math import cos, pi, sin

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.config import Axis
from pointmill.functions import maths, text
from pointmill.operators import bodies, dataset, density_map, exploration, fitting, hydration, map_fit, mass, pairs, profiles, rigid, statistics, symmetry, voxels, windows
from pointmill.operators import spline as splines
from pointmill.plans import profile_fit
from pointmill.plans.inputs import POINTS, SERIES, points, series, table
from pointmill.stored import stored
from pointmill.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Sums of doubles depend on their order in the last places; both sides of a comparison round them."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def significant(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Values that span many orders are rounded to significant digits, so that small ones stay apart."""
    return df.withColumns({c: F.format_string(f"%.{digits - 1}e", c).cast("double") for c in columns})


# --- pair histograms and profiles -------------------------------------------------------------------------------------

_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_HIST = f"""pr AS (SELECT a.w * b.w AS v, {_D} AS d, a.kind AS ka, b.kind AS kb, a.body AS ba, b.body AS bb FROM p a JOIN p b ON a.id < b.id),
 h AS (SELECT bin, sum(value) AS value, sum(cnt)::BIGINT AS cnt, sum(dsum) AS dsum FROM (
   SELECT floor(d * 4 + 0.5)::BIGINT AS bin, sum(v) * 2 AS value, count(*) * 2 AS cnt, sum(d) * 2 AS dsum FROM pr GROUP BY 1
   UNION ALL SELECT 0, sum(w * w), count(*), 0 FROM p) GROUP BY bin)"""
_HIST_BODY = f"""pr AS (SELECT a.w * b.w AS v, {_D} AS d, least(a.body, b.body) AS body_a, greatest(a.body, b.body) AS body_b FROM p a JOIN p b ON a.id < b.id),
 h AS (SELECT body_a, body_b, bin, sum(value) AS value, sum(cnt)::BIGINT AS cnt, sum(dsum) AS dsum FROM (
   SELECT body_a, body_b, floor(d * 4 + 0.5)::BIGINT AS bin, sum(v) * 2 AS value, count(*) * 2 AS cnt, sum(d) * 2 AS dsum FROM pr GROUP BY ALL
   UNION ALL SELECT body, body, 0, sum(w * w), count(*), 0 FROM p GROUP BY body) GROUP BY ALL)"""
_HIST_KIND = f"""pr AS (SELECT a.w * b.w AS v, {_D} AS d, least(a.kind, b.kind) || greatest(a.kind, b.kind) AS kind FROM p a JOIN p b ON a.id < b.id),
 h AS (SELECT kind, bin, sum(value) AS value, sum(cnt)::BIGINT AS cnt, sum(dsum) AS dsum FROM (
   SELECT kind, floor(d * 4 + 0.5)::BIGINT AS bin, sum(v) * 2 AS value, count(*) * 2 AS cnt, sum(d) * 2 AS dsum FROM pr GROUP BY ALL
   UNION ALL SELECT kind || kind, 0, sum(w * w), count(*), 0 FROM p GROUP BY kind) GROUP BY ALL)"""
_Q = "q AS (SELECT 1e-4 + i * ((1 - 1e-4) / 200) AS q FROM range(0, 200) t(i) WHERE 1e-4 + i * ((1 - 1e-4) / 200) < 0.5 - 1e-12)"
_SINC = "CASE WHEN q * d < 1e-3 THEN 1 - (q * d) * (q * d) / 6 + (q * d) * (q * d) * (q * d) * (q * d) / 120 ELSE sin(q * d) / (q * d) END"


@query(f"WITH {POINTS}, {_HIST} SELECT bin, value, cnt, round(dsum, 4) AS dsum FROM h")
def pair_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of points and each with itself, by distance."""
    return rounded(pairs.pair_histogram(points(spark, sf_dir)), {"dsum": 4})


@query(f"WITH {POINTS}, {_HIST_BODY} SELECT body_a, body_b, bin, value, cnt, round(dsum, 4) AS dsum FROM h")
def pair_histogram_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.pair_histogram(points(spark, sf_dir), ["body"]), {"dsum": 4})


@query(f"WITH {POINTS}, {_HIST_KIND} SELECT kind, bin, value, cnt, round(dsum, 4) AS dsum FROM h")
def pair_histogram_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.merge(pairs.kinds(points(spark, sf_dir), "kind"), ["kind"]), {"dsum": 4}).select("kind", "bin", "value", "cnt", "dsum")


@query(f"WITH {POINTS} SELECT floor(d * 4 + 0.5)::BIGINT AS bin, sum(v) * 2 AS value, (count(*) * 2)::BIGINT AS cnt, round(sum(d) * 2, 4) AS dsum FROM (SELECT a.w * b.w AS v, {_D} AS d FROM p a, p b WHERE a.body = 0 AND b.body <> 0) GROUP BY 1")
def cross_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return rounded(pairs.cross_histogram(p.where("body = 0"), p.where("body <> 0")), {"dsum": 4})


@query(f"WITH {POINTS}, {_HIST} SELECT bin, round(CASE WHEN cnt > 0 THEN dsum / cnt ELSE bin * 0.25 END, 6) AS d FROM h")
def weighted_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.weighted_axis(pairs.pair_histogram(points(spark, sf_dir))).select("bin", "d"), {"d": 6})


@query(f"WITH {POINTS}, {_HIST_KIND} SELECT bin, sum(value) AS value, sum(cnt)::BIGINT AS cnt, round(sum(dsum), 4) AS dsum FROM h GROUP BY bin")
def total_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.merge(pairs.kinds(points(spark, sf_dir), "kind").drop("kind")), {"dsum": 4})


@query(f"WITH {POINTS}, {_HIST_KIND} SELECT bin, round(sum(value * pow(1.5, length(kind) - length(replace(kind, 'w', '')))), 4) AS value FROM h GROUP BY bin")
def water_scaled_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.scaled_total(pairs.kinds(points(spark, sf_dir), "kind"), "w", 1.5), {"value": 4})


@query(f"WITH {POINTS}, {_HIST}, {_Q} SELECT round(q, 10) AS q, round(sum(value * ({_SINC})) * exp(-q * q), 2) AS intensity FROM q, (SELECT value, CASE WHEN cnt > 0 THEN dsum / cnt ELSE bin * 0.25 END AS d FROM h WHERE value <> 0) GROUP BY q.q")
def debye_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pair histogram, then its kernel transform over q."""
    return rounded(profile_fit.profile(points(spark, sf_dir)), {"q": 10, "intensity": 2})


_PARTIAL = f"WITH {POINTS}, {_HIST_KIND}, {_Q}, i AS (SELECT q, kind, sum(value * ({_SINC})) * exp(-q * q) AS intensity FROM q, (SELECT kind, value, CASE WHEN cnt > 0 THEN dsum / cnt ELSE bin * 0.25 END AS d FROM h WHERE value <> 0) GROUP BY q, kind)"


@query(f"{_PARTIAL} SELECT round(q, 10) AS q, kind, round(intensity, 2) AS intensity FROM i")
def debye_partial_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile_fit.partial_profiles(points(spark, sf_dir)), {"q": 10, "intensity": 2}).select("q", "kind", "intensity")


_SIGNS = {"aa": 1.0, "ax": -1.0, "aw": 1.0, "xx": 1.0, "wx": -1.0, "ww": 1.0}


@query(f"{_PARTIAL} SELECT round(q, 10) AS q, round(sum(CASE WHEN kind IN ('ax', 'wx') THEN -intensity ELSE intensity END), 2) AS intensity FROM i GROUP BY q")
def six_term_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aa - ax + aw + xx - wx + ww."""
    return rounded(profiles.combined(profile_fit.partial_profiles(points(spark, sf_dir)), _SIGNS), {"q": 10, "intensity": 2})


@query(f"{_PARTIAL} SELECT round(q, 10) AS q, kind, round(intensity * pow(exp(-q * q * (0.25 / 2)), length(kind) - length(replace(kind, 'a', ''))), 2) AS intensity FROM i")
def debye_waller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thermal motion of 0.5 at each end of kind a."""
    ends = F.length("kind") - F.length(F.replace("kind", F.lit("a"), F.lit("")))
    p = profile_fit.partial_profiles(points(spark, sf_dir))
    return rounded(p.withColumn("intensity", F.col("intensity") * profiles.debye_waller(F.col("q"), 0.5, ends)), {"q": 10, "intensity": 2}).select("q", "kind", "intensity")


@query(f"WITH {POINTS}, q AS (SELECT i * 0.05::DOUBLE AS q FROM range(1, 11) t(i)), pr AS (SELECT a.w * b.w * 2 AS v, {_D} AS d FROM p a JOIN p b ON a.id < b.id UNION ALL SELECT w * w, 0 FROM p) SELECT round(q, 10) AS q, round(sum(v * ({_SINC})), 2) AS intensity FROM q, pr GROUP BY q.q")
def exact_debye(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.range(1, 11).select((F.col("id") * 0.05).alias("q"))
    return rounded(profiles.exact(points(spark, sf_dir), q, bounded=False), {"q": 10, "intensity": 2})


_FACTORS = ((0, 1.0, 2.0), (1, 2.0, 10.0), (2, 0.5, 5.0))


@query(
    f"WITH {POINTS}, pr AS (SELECT least(a.body % 3, b.body % 3) AS ff_a, greatest(a.body % 3, b.body % 3) AS ff_b, {_D} AS d FROM p a JOIN p b ON a.id < b.id), "
    "h AS (SELECT ff_a, ff_b, bin, sum(c) AS value, sum(c)::BIGINT AS cnt, sum(s) AS dsum FROM (SELECT ff_a, ff_b, floor(d * 4 + 0.5)::BIGINT AS bin, count(*) * 2 AS c, sum(d) * 2 AS s FROM pr GROUP BY ALL UNION ALL SELECT body % 3, body % 3, 0, count(*), 0 FROM p GROUP BY ALL) GROUP BY ALL), "
    f"q AS (SELECT i * 0.05::DOUBLE AS q FROM range(1, 11) t(i)), f(ff, a, b) AS (VALUES {', '.join(map(str, _FACTORS))}), "
    f"i AS (SELECT q, ff_a, ff_b, sum(value * ({_SINC})) AS intensity FROM q, (SELECT ff_a, ff_b, value, dsum / cnt AS d FROM h) GROUP BY ALL) "
    "SELECT round(q, 10) AS q, round(sum(intensity * (x.a * exp(-x.b * q * q) + 1.0) * (y.a * exp(-y.b * q * q) + 1.0)), 2) AS intensity FROM i JOIN f x ON ff_a = x.ff JOIN f y ON ff_b = y.ff GROUP BY q"
)
def category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts by category, transformed, times both categories' Gaussian factors."""
    p = points(spark, sf_dir).withColumn("ff", F.col("body") % 3).withColumn("w", F.lit(1.0))
    q = spark.range(1, 11).select((F.col("id") * 0.05).alias("q"))
    own = profiles.transform(pairs.pair_histogram(p, ["ff"]), q, ["ff_a", "ff_b"], enveloped=False)
    table_ = spark.createDataFrame(list(_FACTORS), "ff long, a double, b double").join(q)
    factors = table_.select("ff", "q", (F.col("a") * F.exp(-F.col("b") * F.col("q") * F.col("q")) + 1.0).alias("f"))
    return rounded(profiles.with_form_factors(own, factors), {"q": 10, "intensity": 2})


@query(f"WITH {POINTS}, {_HIST_BODY}, t AS (SELECT bin, sum(value) AS value, sum(cnt)::BIGINT AS cnt, sum(dsum) AS dsum FROM h GROUP BY bin) SELECT bin, value, cnt, round(dsum, 4) AS dsum FROM t".replace("FROM embeddings)", "FROM (SELECT vec_id, CASE WHEN label = 3 THEN list_transform(embedding, lambda v: v * 2) ELSE embedding END AS embedding, label FROM embeddings))"))
def incremental_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body 3 is scaled by two: its pairs are computed again and replace their rows; the total is as if all had been."""
    old = points(spark, sf_dir)
    new = old.withColumns({c: F.when(F.col("body") == 3, F.col(c) * 2).otherwise(F.col(c)) for c in "xyz"})
    return rounded(incremental.total(incremental.update(incremental.by_body_pairs(old), new, [3])), {"dsum": 4})


_TURNS = [(k, cos(2 * pi * k / 3), sin(2 * pi * k / 3)) for k in range(3)]


@query(f"WITH {POINTS}, t(copy, c, s) AS (VALUES {', '.join(f'({k}, {c!r}, {s!r})' for k, c, s in _TURNS)}) SELECT id, copy, round(c * x - s * y, 6) AS x, round(s * x + c * y, 6) AS y, round(z, 6) AS z FROM p, t WHERE body = 1")
def symmetry_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body 1 under the rotations of c3."""
    made = symmetry.transforms(spark, {1: symmetry.group("c3")})
    out = symmetry.copies(points(spark, sf_dir), made).select("id", "copy", "x", "y", "z")
    return rounded(out, dict.fromkeys("xyz", 6))


_MOVES = [(1, symmetry.rotation((0, 0, 1), 0.5), (1.0, 0.0, 0.0)), (2, symmetry.rotation((1, 0, 0), -0.25), (0.0, 2.0, 0.0)), (3, symmetry.rotation((0, 1, 0), 1.0), (0.0, 0.0, -1.5))]
_MOVE_ROWS = ", ".join(f"({k}, {b}, {', '.join(repr(float(v)) for v in r.ravel())}, {', '.join(map(repr, t))})" for k, (b, r, t) in enumerate(_MOVES))


@query(
    f"WITH {POINTS}, m(move, moving, r00, r01, r02, r10, r11, r12, r20, r21, r22, t0, t1, t2) AS (VALUES {_MOVE_ROWS}), "
    "v AS (SELECT move, id, w, CASE WHEN body = moving THEN r00 * x + r01 * y + r02 * z + t0 ELSE x END AS x, CASE WHEN body = moving THEN r10 * x + r11 * y + r12 * z + t1 ELSE y END AS y, CASE WHEN body = moving THEN r20 * x + r21 * y + r22 * z + t2 ELSE z END AS z FROM p, m), "
    f"pr AS (SELECT a.move, a.w * b.w AS v, {_D} AS d FROM v a JOIN v b ON a.move = b.move AND a.id < b.id) "
    "SELECT move, bin, sum(value) AS value, sum(cnt)::BIGINT AS cnt, round(sum(dsum), 3) AS dsum FROM (SELECT move, floor(d * 4 + 0.5)::BIGINT AS bin, sum(v) * 2 AS value, count(*) * 2 AS cnt, sum(d) * 2 AS dsum FROM pr GROUP BY ALL UNION ALL SELECT move, 0, sum(w * w), count(*), 0 FROM v GROUP BY move) GROUP BY ALL"
)
def move_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three moves of a body each, tried in one job."""
    return rounded(rigid.move_histograms(points(spark, sf_dir), [(b, r, np.array(t)) for b, r, t in _MOVES]), {"dsum": 3})


@query()
def move_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three moves against the curve that the second one gives: it must fit best."""
    p, moves = points(spark, sf_dir), [(b, r, np.array(t)) for b, r, t in _MOVES]
    truth = rigid.place(p, {b: (moves[1][1], moves[1][2]) if b == moves[1][0] else (np.eye(3), np.zeros(3)) for b in range(10)})
    return significant(rigid.scores(p, moves, profile_fit.simulate(truth, 40)), "chi2", "total")


# --- series -----------------------------------------------------------------------------------------------------------


@query(f"WITH {SERIES} SELECT set_id, i, x, y FROM s WHERE x BETWEEN 0.1 AND 0.4")
def limit_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.limit_x(series(spark, sf_dir), 0.1, 0.4).select("set_id", "i", "x", "y")


@query("WITH s AS (SELECT o_orderpriority AS set_id, o_orderkey AS i, o_totalprice AS x FROM orders), stop AS (SELECT set_id, min(i) AS stop FROM s WHERE x > 400000 GROUP BY 1) SELECT s.set_id, i, x FROM s LEFT JOIN stop USING (set_id) WHERE x BETWEEN 1000 AND 400000 AND (stop IS NULL OR i < stop)")
def limit_x_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("set_id"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("x"))
    return dataset.limit_x(orders, 1000, 400_000, sorted_x=False).select("set_id", "i", "x")


@query("SELECT o_orderkey, o_totalprice AS y FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def limit_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.limit_y(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("y")), 100_000, 200_000)


@query("SELECT o_orderdate, o_orderkey AS id, o_totalprice FROM orders")
def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.rename_columns(dataset.select_columns(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey", "o_totalprice"]), {"o_orderkey": "id"})


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def append_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return dataset.append(c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query(f"WITH {SERIES} SELECT set_id, i, y FROM s WHERE i >= 100")
def skip_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.skip_rows(series(spark, sf_dir), 100).select("set_id", "i", "y")


@query("SELECT o_orderpriority AS set_id, o_orderkey AS i, o_totalprice AS x FROM orders")
def sort_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.sort_x(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("set_id"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("x")))


@query(f"WITH {SERIES} SELECT set_id, i, y * 2.5 AS y, yerr * 2.5 AS yerr FROM s")
def scale_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.scale_y(series(spark, sf_dir), 2.5).select("set_id", "i", "y", "yerr")


@query(f"WITH {SERIES}, f AS (SELECT set_id, 10.0 / y AS factor FROM s WHERE i = 0) SELECT set_id, i, round(y * factor, 8) AS y, round(factor, 8) AS factor FROM s JOIN f USING (set_id)")
def normalize_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dataset.normalize(series(spark, sf_dir), 10.0).select("set_id", "i", "y", "factor"), {"y": 8, "factor": 8})


@query(f"WITH {SERIES}, f AS (SELECT set_id, y AS y0 FROM s WHERE i = 0) SELECT set_id, i, round(y0 * (1 + 0.1 / pow(x, 1.2)) * 1e-4, 8) AS yerr FROM s JOIN f USING (set_id)")
def simulate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dataset.simulate_errors(series(spark, sf_dir)).select("set_id", "i", "yerr"), {"yerr": 8})


def _average_sql(steps: int, base: float) -> str:
    w = "PARTITION BY set_id ORDER BY i"
    terms = [(k, f"CASE WHEN r >= {abs(k)} THEN {base ** -abs(k)!r} * {f'lead(y, {k})' if k > 0 else f'lag(y, {-k})' if k < 0 else 'first_value(y)'} OVER ({w}{' ROWS BETWEEN CURRENT ROW AND CURRENT ROW' if k == 0 else ''}) ELSE 0 END") for k in range(-steps, steps + 1)]
    weights = " + ".join(f"CASE WHEN r >= {abs(k)} THEN {base ** -abs(k)!r} ELSE 0 END" for k in range(-steps, steps + 1))
    return f"WITH {SERIES}, e AS (SELECT *, least(i, n - 1 - i, {steps}) AS r FROM s) SELECT set_id, i, round(({' + '.join(t for _, t in terms)}) / ({weights}), 6) AS y FROM e"


@query(_average_sql(3, 1.5))
def moving_average_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.moving_average(series(spark, sf_dir), 7).select("set_id", "i", "y"), {"y": 6})


@query(_average_sql(2, 1.0))
def moving_average_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.moving_average(series(spark, sf_dir), 5, half_weight=False).select("set_id", "i", "y"), {"y": 6})


@query(f"WITH {SERIES}, r AS (SELECT *, floor(y / 100) AS v FROM s) SELECT set_id, i, v AS y FROM (SELECT *, lag(v) OVER (PARTITION BY set_id ORDER BY i) AS b FROM r) WHERE b IS NULL OR v <> b")
def dedupe_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).withColumn("y", F.floor(F.col("y") / 100).cast("double"))
    return dataset.remove_consecutive_duplicates(s).select("set_id", "i", "y")


@query(f"WITH {SERIES} SELECT set_id, i, x, y FROM s WHERE n < 100 OR ceil(i / (n / 100.0::DOUBLE)) <> ceil((i + 1) / (n / 100.0::DOUBLE))")
def reduce_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.reduce_linear(series(spark, sf_dir), 100).select("set_id", "i", "x", "y")


@query(f"WITH {SERIES}, e AS (SELECT *, min(x) OVER (PARTITION BY set_id) AS a, max(x) OVER (PARTITION BY set_id) AS b FROM s), k AS (SELECT *, floor((log10(x) - log10(a)) / ((log10(b) - log10(a)) / 49) + 1e-9) AS k FROM e) SELECT set_id, i, x, y FROM (SELECT *, lag(k) OVER (PARTITION BY set_id ORDER BY i) AS before FROM k) WHERE n < 50 OR i = 0 OR k > before")
def reduce_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.reduce_log(series(spark, sf_dir), 50).select("set_id", "i", "x", "y")


@query(
    f"WITH RECURSIVE {SERIES}, f AS (SELECT set_id, 0::BIGINT AS i FROM s WHERE i = 0 UNION ALL SELECT s.set_id, s.i + CASE WHEN s.x > 0.1 THEN 8 WHEN s.x > 0.06 THEN 4 WHEN s.x > 0.03 THEN 2 ELSE 1 END FROM f JOIN s ON s.set_id = f.set_id AND s.i = f.i), "
    "g AS (SELECT set_id, i AS fold, lead(i) OVER (PARTITION BY set_id ORDER BY i) AS after FROM f) "
    "SELECT g.set_id, fold, round(avg(x), 8) AS x, round(sum(y / (yerr * yerr)) / sum(1 / (yerr * yerr)), 6) AS y, round(1 / sqrt(sum(1 / (yerr * yerr))), 6) AS yerr FROM g JOIN s ON s.set_id = g.set_id AND s.i >= fold AND s.i < after GROUP BY ALL"
)
def rebin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dataset.rebin(series(spark, sf_dir)), {"x": 8, "y": 6, "yerr": 6})


@query(f"WITH {SERIES}, e AS (SELECT *, lag(y) OVER (PARTITION BY set_id ORDER BY i) AS a, lead(y) OVER (PARTITION BY set_id ORDER BY i) AS b FROM s) SELECT set_id, i, y FROM e WHERE i = 0 OR i = n - 1 OR (y < a AND y < b)")
def local_minima_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.local_minima(series(spark, sf_dir)).select("set_id", "i", "y")


@query(f"WITH {SERIES}, e AS (SELECT *, lag(y) OVER (PARTITION BY set_id ORDER BY i) AS a, lead(y) OVER (PARTITION BY set_id ORDER BY i) AS b FROM s), c AS (SELECT set_id, count(*) FILTER (y > 1.5 * a AND y > 1.5 * b) AS spikes, count(*) FILTER (y <> 0) AS filled FROM e GROUP BY 1) SELECT *, spikes > 0.25 * filled AS highly_ordered FROM c")
def spike_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.spikes(series(spark, sf_dir))


@query("WITH s AS (SELECT event_type AS set_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, floor(value / 100) AS v FROM events), e AS (SELECT *, lag(v) OVER (PARTITION BY set_id ORDER BY i) AS b FROM s) SELECT set_id, i, sum(CASE WHEN i > 0 AND v <> b THEN 1 ELSE 0 END) OVER (PARTITION BY set_id ORDER BY i)::BIGINT AS part FROM e")
def split_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).withColumn("v", F.floor(F.col("y") / 100))
    return windows.split_by_change(s, "v").select("set_id", "i", "part")


@query()
def spline_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splines.interpolate_between(series(spark, sf_dir), 3)


@query()
def spline_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    at = s.select("set_id").distinct().select("set_id", F.explode(F.sequence(F.lit(1), F.lit(199))).alias("k")).select("set_id", (F.col("k") / 200).alias("x"))
    return splines.interpolate_at(s, at)


@query()
def find_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = windows.moving_average(series(spark, sf_dir), 9)
    return splines.find_minima(smooth, min_spacing=5, min_prominence=0.2)


#: For y = p x, chi2 is a p^2 - 2 b p + c: its least and its walls follow from a, b and c.
_WALLS = (
    f"WITH {SERIES}, t AS (SELECT set_id, sum(x * x / (yerr * yerr)) AS a, sum(x * y / (yerr * yerr)) AS b, sum(y * y / (yerr * yerr)) AS c FROM s GROUP BY 1), "
    "m AS (SELECT *, b / a AS p, c - b * b / a AS least, sqrt(0.5 * (c - b * b / a) / a) AS half FROM t), "
    "e AS (SELECT set_id, avg(a * v * v - 2 * b * v + c) AS mean_chi2 FROM (SELECT *, p - half + half * unnest(range(21)) / 10.0::DOUBLE AS v FROM m) GROUP BY 1) "
    "SELECT set_id, round(p, 2) AS p, round(least, 3) AS chi2, round(p - half, 1) AS low, round(p + half, 1) AS high, round(mean_chi2, 0) AS mean_chi2 FROM m JOIN e USING (set_id)"
)


@query(_WALLS)
def valley_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the slope of each series may go before chi2 is half as much again, from a guess of 1."""
    s = stored(series(spark, sf_dir))
    found = exploration.explore(s, s.select("set_id", F.lit(1.0).alias("guess")).distinct(), lambda p: p * F.col("x"), ["set_id"], rise=0.5, tolerance=1e-8)
    return rounded(found.drop("rounds"), {"p": 2, "chi2": 3, "low": 1, "high": 1, "mean_chi2": 0})


# --- statistics and fits ----------------------------------------------------------------------------------------------


@query(f"WITH {SERIES} SELECT set_id, count(y) AS n, round(avg(y), 6) AS mean, round(var_samp(y), 4) AS variance, round(stddev_samp(y), 6) AS std FROM s GROUP BY 1")
def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.series_statistics(series(spark, sf_dir)), {"mean": 6, "variance": 4, "std": 6})


@query("SELECT l_returnflag, round(sum(l_extendedprice / ((l_quantity) * (l_quantity))) / sum(1 / (l_quantity * l_quantity)), 4) AS mean, round(sqrt(1 / sum(1 / (l_quantity * l_quantity))), 8) AS error FROM lineitem GROUP BY 1")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, error = statistics.weighted_mean("l_extendedprice", "l_quantity")
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(mean.alias("mean"), error.alias("error")), {"mean": 4, "error": 8})


@query("WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, arg_min(l_quantity, -n * 1000.0 + l_quantity) AS mode FROM c GROUP BY 1")
def mode_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.mode(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query("SELECT c_mktsegment AS set_id, min(c_custkey) AS x_min, max(c_custkey) AS x_max, min(c_acctbal) AS y_min, max(c_acctbal) AS y_max, min(c_acctbal) FILTER (c_acctbal > 0) AS y_min_positive FROM customer GROUP BY 1")
def span_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.spans(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("set_id"), F.col("c_custkey").alias("x"), F.col("c_acctbal").alias("y")))


@query(f"WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY y, i) AS k FROM s) SELECT set_id, i, x, y FROM r WHERE k = 1")
def find_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.find_minimum(series(spark, sf_dir))


_FIVE = "f AS (SELECT set_id, sum(1 / (yerr * yerr)) AS s0, sum(x / (yerr * yerr)) AS sx, sum(y / (yerr * yerr)) AS sy, sum(x * x / (yerr * yerr)) AS sxx, sum(x * y / (yerr * yerr)) AS sxy, count(*) AS n FROM s GROUP BY 1), l AS (SELECT set_id, (s0 * sxy - sx * sy) / (s0 * sxx - sx * sx) AS a, (sxx * sy - sx * sxy) / (s0 * sxx - sx * sx) AS b, sqrt(s0 / (s0 * sxx - sx * sx)) AS a_err, sqrt(sxx / (s0 * sxx - sx * sx)) AS b_err, n FROM f)"


@query(f"WITH {SERIES}, {_FIVE} SELECT set_id, round(a, 4) AS a, round(b, 4) AS b, round(a_err, 6) AS a_err, round(b_err, 6) AS b_err, n FROM l")
def weighted_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fitting.regression(series(spark, sf_dir), ["set_id"]), {"a": 4, "b": 4, "a_err": 6, "b_err": 6})


@query(f"WITH {SERIES}, {_FIVE} SELECT set_id, round(sum(pow((y - a * x - b) / yerr, 2)), 3) AS chi2, count(*) - 2 AS dof FROM s JOIN l USING (set_id) GROUP BY 1")
def chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return rounded(fitting.chi2(s, fitting.regression(s, ["set_id"]), ["set_id"]), {"chi2": 3})


@query(f"WITH {SERIES}, c AS (SELECT set_id, k * 10.0::DOUBLE AS p, sum(pow((y - k * 10.0::DOUBLE) / yerr, 2)) AS chi2 FROM s, range(0, 41) t(k) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY chi2, p) AS o FROM c) SELECT set_id, p, round(chi2, 3) AS chi2 FROM r WHERE o = 1")
def grid_scan_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = fitting.grid_scan(series(spark, sf_dir), [10.0 * k for k in range(41)], lambda p: p, ["set_id"])
    return rounded(fitting.best(scan, ["set_id"]), {"chi2": 3})


@query(f"WITH {SERIES} SELECT t.a * 50.0::DOUBLE AS p1, u.b * 10.0::DOUBLE AS p2, round(sum(pow((y - (t.a * 50.0::DOUBLE + u.b * 10.0::DOUBLE * x)) / yerr, 2)), 2) AS chi2 FROM s, range(0, 6) t(a), range(-2, 3) u(b) GROUP BY t.a, u.b")
def landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goodness of fit over a grid of two parameters."""
    return rounded(fitting.landscape(series(spark, sf_dir), [50.0 * i for i in range(6)], [10.0 * j for j in range(-2, 3)], lambda a, b: a + b * F.col("x")), {"chi2": 2})


@query()
def profile_fit_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simulated curve is fitted with every water scale of a grid; that of 1 must win."""
    p = points(spark, sf_dir).where("kind <> 'x'")
    fits = profile_fit.fit_water_scale(p, profile_fit.simulate(p, 40, by_kind=True), [0.0, 0.5, 1.0, 1.5, 2.0])
    return significant(rounded(fits, {"a": 4, "b": 2}), "chi2")


_BIN = "least(greatest(floor((l_extendedprice + 1e-6) / 1100), 0), 99)::BIGINT"
_PRICES = Axis(100, 0.0, 110_000.0)


@query(f"SELECT {_BIN} AS bin, count(*) AS count FROM lineitem GROUP BY 1")
def scalar_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", _PRICES)


@query(f"SELECT least(floor(bin / 7), 13)::BIGINT AS bin, sum(c)::BIGINT AS count FROM (SELECT {_BIN} AS bin, count(*) AS c FROM lineitem GROUP BY 1) GROUP BY 1")
def hist_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.coarsen(scalar_histogram(spark, sf_dir), 7, 100)


@query(f"WITH h AS (SELECT {_BIN} AS bin, count(*) AS count FROM lineitem GROUP BY 1) SELECT bin, count, round(count / (SELECT sum(count) FROM h), 10) AS share FROM h")
def hist_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.normalized(scalar_histogram(spark, sf_dir)), {"share": 10})


@query(f"WITH h AS (SELECT {_BIN} AS bin, count(*) AS count FROM lineitem GROUP BY 1) SELECT bin, count FROM h WHERE bin <= greatest(9, (SELECT max(bin) FROM h))")
def hist_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.shorten(scalar_histogram(spark, sf_dir))


@query(f"SELECT bin, sum(c)::DOUBLE AS count FROM (SELECT {_BIN} AS bin, count(*) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS c FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY {_BIN}, l_returnflag) GROUP BY 1")
def hist_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    a, r = (statistics.histogram(items.where(F.col("l_returnflag") == f), "l_extendedprice", _PRICES) for f in "AR")
    return statistics.combine(a, r, -1.0)


# --- points, voxels, bodies -------------------------------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT body, round(sum(w * x) / sum(w), 6) AS cx, round(sum(w * y) / sum(w), 6) AS cy, round(sum(w * z) / sum(w), 6) AS cz, sum(w) AS mass FROM p GROUP BY body")
def center_of_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mass.centre_of_mass(points(spark, sf_dir), keys=["body"]), {"cx": 6, "cy": 6, "cz": 6})


@query(f"WITH {POINTS}, c AS (SELECT sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * z) / sum(w) AS cz FROM p) SELECT round(sqrt(sum(w * ((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))) / sum(w)), 6) AS rg FROM p, c")
def radius_of_gyration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mass.radius_of_gyration(points(spark, sf_dir)), {"rg": 6})


@query(f"WITH {POINTS} SELECT body, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM p GROUP BY body")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.bounding_box(points(spark, sf_dir), ["body"])


_VOXELS = f"WITH {POINTS}, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM p), v AS (SELECT DISTINCT floor(x - lx + 0.5)::BIGINT AS i, floor(y - ly + 0.5)::BIGINT AS j, floor(z - lz + 0.5)::BIGINT AS k FROM p, b)"
_GROWN = f"{_VOXELS}, g AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM v, range(-2, 3) t(a), range(-2, 3) u(b), range(-2, 3) w(c) WHERE a * a + b * b + c * c <= 4)"


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.to_voxels(points(spark, sf_dir))


@query(f"{_VOXELS} SELECT i, j, k, count(*) AS n FROM (SELECT floor(x - lx + 0.5)::BIGINT AS i, floor(y - ly + 0.5)::BIGINT AS j, floor(z - lz + 0.5)::BIGINT AS k FROM p, b) GROUP BY ALL")
def voxel_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(spark, sf_dir).groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_GROWN} SELECT i, j, k FROM g")
def voxel_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.expand(_voxels(spark, sf_dir), 2.0)


@query(f"{_GROWN} SELECT count(*) AS voxels, count(*)::DOUBLE AS volume FROM g")
def voxel_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.volume(voxel_expand(spark, sf_dir))


@query(f"{_GROWN} SELECT i, j, k, (SELECT count(*) FROM g h WHERE abs(h.i - g.i) + abs(h.j - g.j) + abs(h.k - g.k) = 1) < 6 AS surface FROM g")
def voxel_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.surface(voxel_expand(spark, sf_dir))


@query(f"{_GROWN}, e AS (SELECT i, j, k, lag(k) OVER (PARTITION BY i, j ORDER BY k) AS before FROM g) SELECT i, j, unnest(range(before + 1, k)) AS k FROM e WHERE k - before BETWEEN 2 AND 4")
def voxel_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.holes(voxel_expand(spark, sf_dir), 3)


@query(f"{_GROWN} SELECT i, j, k FROM g WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0")
def voxel_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.strided(voxel_expand(spark, sf_dir), 2)


@query(f"{_VOXELS}, a AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM v, range(-3, 4) t(a), range(-3, 4) u(b), range(-3, 4) w(c) WHERE a * a + b * b + c * c <= 9), b2 AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM v, range(-2, 3) t(a), range(-2, 3) u(b), range(-2, 3) w(c) WHERE a * a + b * b + c * c <= 4) SELECT * FROM a EXCEPT SELECT * FROM b2")
def hydration_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydration.shell_voxels(_voxels(spark, sf_dir), 2.0, 3.0)


@query(f"WITH {POINTS}, o(a, b, c) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)), n AS (SELECT id AS of, x + a * 3 AS x, y + b * 3 AS y, z + c * 3 AS z FROM p, o) SELECT of, x, y, z FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) + (p.z - n.z) * (p.z - n.z) < 6.25)")
def hydration_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates three away along the axes that no point is nearer to than 2.5."""
    p = points(spark, sf_dir)
    return hydration.free(hydration.along_axes(p, 3.0), p, 2.5)


@query(f"WITH {POINTS}, c AS (SELECT body AS centre, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY body), d AS (SELECT id, centre, (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z) AS d2 FROM p, c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, centre) AS o FROM d) SELECT id, centre, round(sqrt(d2), 6) AS distance FROM r WHERE o = 1")
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    centres = p.groupBy(F.col("body").alias("centre")).agg(*[F.avg(c).alias(c) for c in "xyz"])
    return rounded(voxels.nearest_centre(p, centres), {"distance": 6})


@query(f"WITH {POINTS}, m(element, mass, charge) AS (VALUES {', '.join(map(str, mass.ELEMENTS))}), e AS (SELECT body, CASE body % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'C' WHEN 2 THEN 'N' ELSE 'XX' END AS element FROM p) SELECT body, count(*) AS n, round(sum(coalesce(mass, 0)), 4)::DOUBLE AS mass, sum(coalesce(charge, 0))::BIGINT AS charge FROM e LEFT JOIN m USING (element) GROUP BY body")
def category_join_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("body") % 4
    p = points(spark, sf_dir).withColumn("element", F.when(k == 0, "H").when(k == 1, "C").when(k == 2, "N").otherwise("XX"))
    return rounded(mass.masses(p, mass.elements(spark), keys=["body"]), {"mass": 4})


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), k AS (SELECT label FROM c WHERE label NOT IN (0, -1) ORDER BY n DESC, label LIMIT 3) SELECT vec_id AS id, CASE WHEN label = 0 OR label IN (SELECT label FROM k) THEN label ELSE -1 END::BIGINT AS body FROM embeddings")
def compact_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent labels stay, with label 0; the others become -1."""
    return mass.compact_categories(points(spark, sf_dir), "body", 5, -1, (0,)).select("id", F.col("body").cast("long").alias("body"))


@query("WITH b AS (SELECT CASE WHEN value < 50 THEN 0 WHEN value >= 450 THEN 21 ELSE floor((value - 50.0::DOUBLE) / 400.0::DOUBLE * 20)::INT + 1 END AS band FROM events) SELECT band, count(*) AS n FROM b GROUP BY 1")
def threshold_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = density_map.bands(table(spark, sf_dir, "events").select(F.col("value").alias("val")), 20, 50.0, 450.0)
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


_MAP = "v AS (SELECT (o_orderkey % 40)::INT AS x, ((o_orderkey // 40) % 40)::INT AS y, (o_orderkey // 1600)::INT AS z, o_totalprice AS val FROM orders)"


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((k % 40).cast("int").alias("x"), (F.floor(k / 40) % 40).cast("int").alias("y"), F.floor(k / 1600).cast("int").alias("z"), F.col("o_totalprice").alias("val"))


@query(f"WITH {_MAP} SELECT z, x, min(y) AS y_min, max(y) AS y_max, max(y) - min(y) + 1 AS cells FROM v WHERE val >= 200000 GROUP BY ALL")
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_map.bounds(_map(spark, sf_dir), 200_000)


@query(f"WITH {_MAP} SELECT c * 50000.0::DOUBLE AS cutoff, count(*) FILTER (val >= c * 50000.0::DOUBLE) AS voxels, count(*) FILTER (val >= c * 50000.0::DOUBLE) * 8.0::DOUBLE AS volume FROM v, range(1, 9) t(c) GROUP BY c")
def map_cutoff_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_map.cutoff_scan(_map(spark, sf_dir), [50_000.0 * c for c in range(1, 9)], 2.0)


@query(f"WITH {_MAP} SELECT round(avg(val), 4) AS mean, round(sqrt(sum(val * val) / count(*)), 4) AS rms, min(val) AS low, max(val) AS high FROM v")
def map_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density_map.statistics(_map(spark, sf_dir)).drop("squares"), {"mean": 4, "rms": 4})


_LEVELS, _LOW, _HIGH = 5, 480_000.0, 495_000.0


@query(
    f"WITH {_MAP}, p AS (SELECT row_number() OVER (ORDER BY z, y, x) AS id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, CASE WHEN val >= {_HIGH} THEN {_LEVELS} + 1 ELSE floor((val - {_LOW}::DOUBLE) / ({_HIGH} - {_LOW})::DOUBLE * {_LEVELS})::INT + 1 END AS band FROM v WHERE val >= {_LOW}), "
    f"pr AS (SELECT least(a.band, b.band) AS band, {_D} AS d FROM p a JOIN p b ON a.id < b.id), h AS (SELECT band, floor(d * 4 + 0.5)::BIGINT AS bin, count(*) * 2 AS cnt, sum(d) * 2 AS dsum FROM pr GROUP BY ALL UNION ALL SELECT band, 0, count(*), 0 FROM p GROUP BY band) "
    f"SELECT level::INT AS level, bin, sum(cnt)::DOUBLE AS value, sum(cnt)::BIGINT AS cnt, round(sum(dsum), 3) AS dsum FROM h JOIN range(1, {_LEVELS + 1}) t(level) ON band >= level GROUP BY ALL"
)
def map_cutoff_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair histograms of a map at five cutoffs, from one join by density band."""
    p = map_fit.banded_points(_map(spark, sf_dir), _LEVELS, _LOW, _HIGH)
    return rounded(map_fit.cutoff_histograms(p, _LEVELS), {"dsum": 3})


@query()
def map_fit_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve that the third cutoff's voxels give is fitted at every cutoff: the third must win."""
    p = map_fit.banded_points(_map(spark, sf_dir), _LEVELS, _LOW, _HIGH)
    return significant(rounded(map_fit.fit_cutoff(p, profile_fit.simulate(p.where("band >= 3"), 40), _LEVELS), {"a": 4, "b": 2}), "chi2")


@query(f"WITH {POINTS} SELECT id, CASE WHEN body = 2 AND id >= 300 THEN 11 WHEN body = 2 AND id >= 100 THEN 10 WHEN body IN (4, 5) THEN 4 ELSE body END::BIGINT AS body FROM p WHERE body <> 7 UNION ALL SELECT id, 20 FROM p WHERE body = 1")
def body_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body 2 is split at two residues, 4 and 5 merge, 7 goes, 1 is copied."""
    p = bodies.split_at(points(spark, sf_dir).withColumn("residue", F.col("id")), 2, [100, 300])
    return bodies.copy(bodies.delete(bodies.merge(p, [4, 5]), [7]), 1, 20).select("id", "body")


@query(f"WITH {POINTS}, e AS (SELECT a.body AS body_a, b.body AS body_b, {_D} AS distance FROM p a JOIN p b ON abs(a.id - b.id) = 1 AND a.body < b.body) SELECT body_a, body_b, round(min(distance), 6) AS distance FROM e WHERE distance <= 15 GROUP BY ALL")
def body_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest link of neighbouring rows in different bodies."""
    p = points(spark, sf_dir).withColumns({"residue": F.col("id"), "is_calpha": F.lit(True)})
    return rounded(bodies.bonds(p, 15.0).select("body_a", "body_b", "distance"), {"distance": 6})


@query(f"WITH {POINTS} SELECT a.id AS id_a, b.id AS id_b, round(10 * pow({_D} - 5, 4), 3) AS penalty FROM p a JOIN p b ON b.id = a.id + 1")
def constraint_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    ids = p.select("id")
    wanted = ids.withColumnRenamed("id", "id_a").join(ids.select((F.col("id") - 1).alias("id_a"), F.col("id").alias("id_b")), "id_a").withColumns({"rest": F.lit(5.0), "kind": F.lit("bond")})
    return rounded(bodies.constraints(p, wanted).select("id_a", "id_b", "penalty"), {"penalty": 3})


# --- text and expressions ---------------------------------------------------------------------------------------------


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, list_filter(regexp_split_to_array(line, '[ ,\\t\\r\\n]+'), lambda x: x <> '') AS t FROM l) "
    "SELECT doc_id, count(*) AS n_lines, sum(len(t))::BIGINT AS n_tokens, count(*) FILTER (len(t) > 0 AND len(list_filter(t, lambda x: NOT (regexp_full_match(x, '[0-9+\\-.Ee]+') AND regexp_matches(x, '[0-9]')))) = 0) AS n_numeric FROM t GROUP BY doc_id"
)
def text_tokenize_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, tokens, and lines of numbers only, as a curve reader tells them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("t", text.tokens(F.col("line")))
    numeric = (F.size("t") > 0) & F.forall("t", text.is_numeric)
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("t")).alias("n_tokens"), F.count_if(numeric).alias("n_numeric"))


@query("SELECT page_id, regexp_extract(split_part(url, '?', 1), '([^/]*?)(\\.[^./]*)?$', 1) AS stem, regexp_extract(split_part(url, '?', 1), '(\\.[^./]*)$', 1) AS extension FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.split_part("url", F.lit("?"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", text.stem(path).alias("stem"), text.extension(path).alias("extension"))


@query(
    "WITH e AS (SELECT a.vec_id, list_transform(a.embedding, lambda v: v::DOUBLE) AS u, list_transform(b.embedding, lambda v: v::DOUBLE) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) "
    "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: u[i] * v[i])), 8) AS dot, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (u[i] - v[i]) * (u[i] - v[i])))), 8) AS distance FROM e"
)
def vector_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v")), "vec_id")
    return both.select("vec_id", F.round(maths.dot(F.col("u"), F.col("v")), 8).alias("dot"), F.round(maths.distance(F.col("u"), F.col("v")), 8).alias("distance"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregation, run over the table as a batch."""
    return rounded(incremental.windowed(table(spark, sf_dir, "events"), window="1 hour").withColumn("start", F.col("start").cast("timestamp_ntz")), {"total": 4})


# the queries of solvent, symmetry and parameter fits register themselves
from pointmill.plans import assemblies as _assemblies  # noqa: E402, F401
from pointmill.plans import solvent as _solvent  # noqa: E402, F401
from pointmill.plans import surfaces as _surfaces  # noqa: E402, F401
