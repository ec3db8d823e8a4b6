"""Maintenance of pair histograms when bodies change, as a batch step and over a stream of changes.

Histograms are kept by pair of bodies. When bodies change, only the pairs that touch one of them are computed again and
replace their rows; the rest of the table stays. The total over pairs is then the same as if all had been computed anew.

A batch's bodies that are as they were change nothing, and a batch without others writes nothing. Every few versions the state
is written as a base, from which later versions are read: a read covers one base and fewer versions than lie between two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointmill.config import DISTANCE_AXIS
from pointmill.operators.pairs import merge, pair_histogram

KEYS = ["body_a", "body_b"]


def by_body_pairs(points: DataFrame, width: float = DISTANCE_AXIS.width) -> DataFrame:
    """body_a, body_b, bin, value, cnt, dsum for all pairs of bodies."""
    return pair_histogram(points, ["body"], width)


def _parted(points: DataFrame, changed: list[int] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points of changed bodies (ids, or a table with a column body) and all others."""
    if isinstance(changed, DataFrame):
        bodies = changed.select("body").distinct()
        return points.join(bodies, "body", "left_semi"), points.join(bodies, "body", "left_anti")
    return points.where(F.col("body").isin(changed)), points.where(~F.col("body").isin(changed))


def touched(points: DataFrame, changed: list[int] | DataFrame, width: float = DISTANCE_AXIS.width) -> DataFrame:
    """The same for pairs with a changed body. Pairs of unchanged points are not formed: the changed are joined with all."""
    from pointmill.operators.pairs import cross_histogram

    new, old = _parted(points, changed)
    return merge(pair_histogram(new, ["body"], width).unionByName(cross_histogram(new, old, ["body"], width)), KEYS)


def update(partial: DataFrame, points: DataFrame, changed: list[int], width: float = DISTANCE_AXIS.width) -> DataFrame:
    """partial with the rows of changed bodies replaced by what points (the new state) gives."""
    kept = partial.where(~F.col("body_a").isin(changed) & ~F.col("body_b").isin(changed))
    return kept.unionByName(touched(points, changed, width))


def differing(before: DataFrame, changes: DataFrame) -> DataFrame:
    """body of each one in changes (whole new states; an empty body is a row with a null id) that isn't as in before. States
    are compared row by row, repeated rows counted."""
    now = changes.where("id IS NOT NULL").select(*before.columns)
    was = before.join(changes.select("body").distinct(), "body", "left_semi").select(*before.columns)
    return now.exceptAll(was).unionByName(was.exceptAll(now)).select("body").distinct()


def total(partial: DataFrame) -> DataFrame:
    return merge(partial.drop(*KEYS))


def apply_changes(points: DataFrame, changes: DataFrame) -> DataFrame:
    """Points with those of changed bodies replaced; an empty body is given by a row with a null id."""
    gone = changes.select("body").distinct()
    return points.join(gone, "body", "left_anti").unionByName(changes.where("id IS NOT NULL").select(*points.columns))


def begin(points: DataFrame, path: str, width: float = DISTANCE_AXIS.width) -> None:
    """Version 0 of the tables below path: all points, and the histograms of all pairs of bodies."""
    points.write.mode("overwrite").parquet(f"{path}/points/version=0")
    by_body_pairs(points, width).write.mode("overwrite").parquet(f"{path}/pairs/version=0")
    points.select("body").distinct().write.mode("overwrite").parquet(f"{path}/changed/version=0")


def _base(spark: SparkSession, path: str, version: int) -> int:
    """The last base up to a version, -1 where there is none."""
    try:
        done = spark.read.parquet(f"{path}/base/done")
    except AnalysisException:  # no base yet
        return -1
    found = done.where(F.col("version") <= version).agg(F.max("version")).first()[0]
    return -1 if found is None else found


def _rows(spark: SparkSession, path: str, table: str, version: int, base: int) -> DataFrame:
    """A table's rows of a base and of the versions after it, up to the given one; others are pruned by their folders."""
    later = spark.read.parquet(f"{path}/{table}").where(F.col("version").between(base + 1, version))
    return later if base < 0 else spark.read.parquet(f"{path}/base/{table}").where(F.col("version") == base).unionByName(later)


def _last(spark: SparkSession, path: str, version: int, base: int) -> DataFrame:
    """body and the last version, up to the given one, in which it changed: a row for each body."""
    return _rows(spark, path, "changed", version, base).groupBy("body").agg(F.max("version").alias("last"))


def current_points(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The points as of a version: each body's rows of the version in which it last changed."""
    base = _base(spark, path, version)
    rows = _rows(spark, path, "points", version, base)
    return rows.join(_last(spark, path, version, base), "body").where("version = last").drop("version", "last")


def current_pairs(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The histograms as of a version: a pair's rows are those of the later of both bodies' last changes."""
    base = _base(spark, path, version)
    rows, last = _rows(spark, path, "pairs", version, base), _last(spark, path, version, base)
    one = rows.join(last.withColumnsRenamed({"body": "body_a", "last": "last_a"}), "body_a")
    both = one.join(last.withColumnsRenamed({"body": "body_b", "last": "last_b"}), "body_b")
    return both.where(F.col("version") == F.greatest("last_a", "last_b")).drop("version", "last_a", "last_b")


def compact(spark: SparkSession, path: str, version: int) -> None:
    """Writes the state as of a version as a base. Reads of it and of later versions no longer touch what lies before; a
    base that was not written to its end is not read. Folders of versions before it may then be removed by their owner."""
    points = current_points(spark, path, version)
    points.write.mode("overwrite").parquet(f"{path}/base/points/version={version}")
    current_pairs(spark, path, version).write.mode("overwrite").parquet(f"{path}/base/pairs/version={version}")
    bodies = points.select("body").distinct()
    bodies.write.mode("overwrite").parquet(f"{path}/base/changed/version={version}")
    bodies.agg(F.count(F.lit(1)).alias("bodies")).write.mode("overwrite").parquet(f"{path}/base/done/version={version}")


def maintain(changes: DataFrame, path: str, checkpoint: str, width: float = DISTANCE_AXIS.width, on_update: Callable[[int], None] | None = None, base_every: int = 20) -> StreamingQuery:
    """A streaming query over changes (whole new states of bodies; an empty one is a row with a null id). Batch n writes
    version n + 1 below path: the bodies that differ from before, their points and the histograms of the pairs that touch
    them, nothing else, and nothing at all if none differs; which bodies changed is written last. Every base_every versions
    there is a base. A batch reads versions up to n alone and overwrites its own, so one that runs again gives the same
    tables."""

    def step(batch: DataFrame, number: int) -> None:
        spark, version = batch.sparkSession, number + 1
        batch = batch.persist()
        before = current_points(spark, path, number)
        changed = differing(before, batch).persist()  # ids of the bodies of one batch
        if not changed.isEmpty():
            new = batch.join(changed, "body", "left_semi").where("id IS NOT NULL").select(*before.columns)
            now = before.join(changed, "body", "left_anti").unionByName(new)
            new.write.mode("overwrite").parquet(f"{path}/points/version={version}")
            touched(now, changed, width).write.mode("overwrite").parquet(f"{path}/pairs/version={version}")
            changed.write.mode("overwrite").parquet(f"{path}/changed/version={version}")
        changed.unpersist()
        batch.unpersist()
        if version % base_every == 0:
            compact(spark, path, version)
        if on_update:
            on_update(version)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def windowed(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts, sums and bounds of event values by type and window of event time; late rows within the watermark count."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", window), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total", "low", "high")
    )
