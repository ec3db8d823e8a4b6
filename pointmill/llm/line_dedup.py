"""Line dedup by site-relative frequency: a line that stands on too large a share of its host's pages is boilerplate.

For each host, the pages that contain a line are divided by the host's pages; lines above the ratio (and on at least
min_pages pages, so that small hosts keep their text) are dropped from every page of that host. Lines are compared whole.
Lines without a visible character are neither counted nor dropped; a line counts once a page however often it stands there.

Null texts stay null and count as pages; pages without a host are a host of their own; repeated rows are pages of their
own. A page may lose all its lines: it stays, with an empty text. A line exactly at the ratio stays. Very long texts are
read whole. Other columns pass through whatever their names; where pages has a column dedup_lines or dedup_dropped, the new
one has an underscore before its name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import cut, free_name, salted_join

MAX_RATIO = 0.1
MIN_PAGES = 5
#: Boilerplate lines are broadcast as one list a host up to so many in all, and so many of a host. Beyond either, pages meet
#: them line by line in a join by host and line.
BROADCAST_LINES, LIST_LINES = 50_000, 500
_BLANK = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _visible(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK)) != ""


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, key, n_pages of each line to drop."""
    slim = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = slim.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _visible), _key))
    counts = slim.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_pages"))
    frequent = counts.where(F.col("n_pages") >= min_pages)
    return frequent.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("n_pages") > max_ratio * F.col("host_pages")).select("c.host", "key", "n_pages")


def _by_list(pages: DataFrame, found: DataFrame, host: str, text: str, kept: str) -> DataFrame:
    """Adds kept, the lines that stay: each host's boilerplate lines are few, and all of them are broadcast."""
    own, drop = free_name(pages, "host_of_lines"), free_name(pages, "lines_to_drop")
    by_host = found.groupBy(F.col("host").alias(own)).agg(F.collect_list("key").alias(drop))
    joined = pages.alias("p").join(F.broadcast(by_host), F.col(f"p.{host}").eqNullSafe(F.col(own)), "left")
    lines = _lines(F.col(text))
    return joined.withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(drop), _key(x))))).drop(own, drop)


def _by_line(pages: DataFrame, found: DataFrame, host: str, text: str, kept: str) -> DataFrame:
    """Adds kept: (host, line) pairs meet in a join that deals out frequent ones, and the places to drop come back to the
    pages of that host and text. No text is shuffled but with its page."""
    names = {n: free_name(pages, f"line_{n}") for n in ("site", "none", "t1", "t2", "drop")}
    whole = F.col(text)
    tagged = pages.withColumns({names["site"]: F.coalesce(F.col(host).cast("string"), F.lit("")), names["none"]: F.col(host).isNull(), names["t1"]: F.xxhash64(whole), names["t2"]: F.xxhash64(F.lit("text"), whole)})
    page = tagged.select(*[F.col(names[n]).alias(n) for n in ("site", "none", "t1", "t2")], F.posexplode(F.transform(_lines(whole), _key)).alias("at", "key")).select("site", "none", "t1", "t2", "at", "key.a", "key.b")
    bad = found.select(F.coalesce(F.col("host").cast("string"), F.lit("")).alias("site"), F.col("host").isNull().alias("none"), "key.a", "key.b").distinct()
    hits = salted_join(page, bad, ["site", "none", "a", "b"], F.struct("t1", "at"))
    drops = hits.groupBy("site", "none", "t1", "t2").agg(F.collect_set("at").alias(names["drop"]))  # a page's lines at most
    drops = drops.withColumnsRenamed({n: names[n] for n in ("site", "none", "t1", "t2")})
    rest = F.struct(*[F.col(c) for c, t in pages.dtypes if "map<" not in t])  # parts the copies of one text by their other columns
    joined = salted_join(tagged, drops, [names[n] for n in ("site", "none", "t1", "t2")], rest, "left")
    lines = _lines(whole)
    stays = F.when(F.col(names["drop"]).isNull(), lines).otherwise(F.filter(lines, lambda x, i: ~F.array_contains(F.col(names["drop"]), i)))
    return joined.withColumn(kept, stays).drop(*names.values())


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with the text rid of boilerplate lines, and the columns dedup_lines and dedup_dropped (how many there were)."""
    found = cut(boilerplate(pages, host, text, max_ratio, min_pages))
    kept, counted, dropped = (free_name(pages, n) for n in ("lines_kept", "dedup_lines", "dedup_dropped"))
    small = found.count() <= BROADCAST_LINES and found.groupBy("host").count().where(F.col("count") > LIST_LINES).isEmpty()
    out = (_by_list if small else _by_line)(pages, found, host, text, kept)
    n = F.size(_lines(F.col(text))).cast("long")
    made = out.select(*[F.col(c) for c in pages.columns], kept, n.alias(counted), (n - F.size(kept)).alias(dropped))
    return made.withColumn(text, F.array_join(kept, "\n")).drop(kept)


ORACLE_SQL = f"""
WITH lines AS (
  SELECT source, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''))) AS line
  FROM documents),
totals AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
bad AS (
  SELECT l.source, list(l.line) AS lines FROM (SELECT source, line, count(*) AS c FROM lines GROUP BY source, line) l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE c >= {MIN_PAGES} AND c > {MAX_RATIO} * t.n GROUP BY l.source),
kept AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS before,
         CASE WHEN b.lines IS NULL THEN string_split(d.text, chr(10)) ELSE list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(b.lines, x)) END AS after
  FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN before IS NOT NULL THEN coalesce(array_to_string(after, chr(10)), '') END AS text, len(before) AS dedup_lines, len(before) - len(after) AS dedup_dropped FROM kept
"""
