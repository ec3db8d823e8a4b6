from pyspark.sql import functions as F

from pointmill.operators import pairs
from pointmill.streaming import incremental
from tests.test_points import cloud, counts


def test_stream_of_changes(spark, tmp_path):
    """Only what touches changed bodies is written; every version equals the histogram of its points."""
    old, path = cloud(spark, 40, 5), str(tmp_path / "tables")
    incremental.begin(old, path)
    feed = str(tmp_path / "feed")
    for k in (1, 2):
        old.where(F.col("body") == k).withColumn("x", F.col("x") + 3.0 * k).coalesce(1).write.mode("append").parquet(feed)
    gone = old.where(F.col("body") == 0).limit(1).withColumn("id", F.lit(None).cast(old.schema["id"].dataType))
    gone.coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(old.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    seen = []
    q = incremental.maintain(stream, path, str(tmp_path / "ck"), on_update=seen.append)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert max(seen) == 3
    for version in range(4):
        points = incremental.current_points(spark, path, version)
        assert counts(incremental.total(incremental.current_pairs(spark, path, version))) == counts(pairs.merge(pairs.pair_histogram(points)))
    bodies = old.select("body").distinct().count()
    assert incremental.current_points(spark, path, 3).select("body").distinct().count() == bodies - 1
    pairs_of = spark.read.parquet(f"{path}/pairs").where("version = 1").select("body_a", "body_b").distinct().count()
    assert pairs_of == bodies


def test_unchanged_bodies_write_nothing_and_reads_stay_bounded(spark, tmp_path):
    """Seven batches, of which two repeat a state and one empties a body that is empty already; bases every third version."""
    import os

    old, path, feed = cloud(spark, 30, 9), str(tmp_path / "tables"), str(tmp_path / "feed")
    incremental.begin(old, path)

    def state(body, shift):
        return old.where(F.col("body") == body).withColumn("x", F.col("x") + shift)

    gone = old.where(F.col("body") == 0).limit(1).withColumn("id", F.lit(None).cast(old.schema["id"].dataType))
    batches = [state(1, 0.0), state(1, 3.0), state(1, 3.0).unionByName(state(2, 1.0)), gone, gone, state(2, 5.0), state(0, 2.0)]
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(old.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    q = incremental.maintain(stream, path, str(tmp_path / "ck"), base_every=3)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    written = {t: {int(d.split("=")[1]) for d in os.listdir(f"{path}/{t}") if d.startswith("version=")} for t in ("points", "pairs", "changed")}
    assert written["points"] == written["pairs"] == written["changed"] == {0, 2, 3, 4, 6, 7}
    assert {r["body"] for r in spark.read.parquet(f"{path}/changed").where("version = 3").collect()} == {2}
    for version in range(8):
        points = incremental.current_points(spark, path, version)
        assert counts(incremental.total(incremental.current_pairs(spark, path, version))) == counts(pairs.merge(pairs.pair_histogram(points)))
        base = incremental._base(spark, path, version)
        assert base == (-1 if version < 3 else version // 3 * 3)
        read = {r["version"] for r in incremental._rows(spark, path, "pairs", version, base).select("version").distinct().collect()}
        assert all(base <= v <= version for v in read) and len(read) <= 3
    assert incremental.current_points(spark, path, 5).where("body = 0").count() == 0
    want = state(0, 2.0).unionByName(state(1, 3.0)).unionByName(state(2, 5.0))
    assert sorted(map(tuple, incremental.current_points(spark, path, 7).select(*old.columns).collect())) == sorted(map(tuple, want.collect()))


def test_windows_of_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed(stream, window="1 hour").writeStream.outputMode("complete").format("memory").queryName("windows_out").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    a = {(r["start"], r["event_type"]): r["n"] for r in spark.table("windows_out").collect()}
    b = {(r["start"], r["event_type"]): r["n"] for r in incremental.windowed(events, window="1 hour").collect()}
    assert a == b and len(a) > 10
