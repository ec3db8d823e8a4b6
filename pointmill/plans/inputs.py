"""The tables of a folder as the library's inputs: series, point clouds, centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.ordered import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type are a series in order of time: set_id, i, n, x = (i + 1) / n, y, yerr = 1 + y / 10."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("set_id"), "ts", "event_id", F.col("value").alias("y"))
    placed = number_rows(events, ["set_id"], ["ts", "event_id"], F.date_trunc("day", "ts"))
    return placed.select("set_id", "i", "n", ((F.col("i") + 1) / F.col("n")).alias("x"), "y", (1 + F.col("y") * 0.1).alias("yerr"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: the first three components times ten, weight label + 1; kind w for label 0, x for 9, else a."""
    e = table(spark, sf_dir, "embeddings")
    xyz = [(F.col("embedding")[k].cast("double") * 10).alias(c) for k, c in enumerate("xyz")]
    kind = F.when(F.col("label") == 0, "w").when(F.col("label") == 9, "x").otherwise("a")
    return e.select(F.col("vec_id").alias("id"), *xyz, (F.col("label") + 1).cast("double").alias("w"), F.col("label").cast("long").alias("body"), kind.alias("kind"))


SERIES = """s AS (SELECT *, (i + 1)::DOUBLE / n AS x, 1 + y * 0.1 AS yerr FROM (
  SELECT event_type AS set_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, value AS y FROM events))"""

POINTS = """p AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z, (label + 1)::DOUBLE AS w,
  label::BIGINT AS body, CASE label WHEN 0 THEN 'w' WHEN 9 THEN 'x' ELSE 'a' END AS kind FROM embeddings)"""
