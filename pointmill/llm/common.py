"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_PER_BATCH = 1000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset, a folder of our own on a local master, as
    in tests; on a cluster, whose executors would not see that folder, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pointmill-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that later steps neither compute it again nor depend on executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_in_shared_folder(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; columns that a later step doesn't read stay unread."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand at most ROWS_PER_BATCH rows at once to Python in this session: for executors of little memory beside
    the heap. The registered queries and the pipeline ask for it; operators leave the session as it is."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch, called on slices of few rows.

    Spark bounds the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB), so no session setting is touched
    here; see small_batches for less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                if (out := fn(batch.slice(at, ROWS_PER_BATCH))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str, *others: DataFrame) -> str:
    """name, or with underscores before it, so that neither df nor the others have such a column."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def training_share(doc_id: Column) -> Column:
    """True for rows that may be learnt from: crc32(doc_id as text) mod 5 isn't 0."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Keys of a join that are dealt out further at most, and rows of a key from which it is.
HOT_KEYS, HOT_ROWS = 1000, 1000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """left joined with right, which has a row for each key at most, where a few keys may hold most rows of left.

    The keys of most rows (at most HOT_KEYS of them, so their list may be broadcast; any other key holds under a thousandth
    of the rows) are dealt by a hash of spread into parts of about HOT_ROWS rows, and right's row goes to every part. Keys
    are never null; how is inner or left. Other columns pass through whatever their names."""
    part, parts = free_name(left, "__part", right), free_name(left, "__parts", right)
    key_names = [free_name(left, f"__hot_{i}", right) for i in range(len(keys))]
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS)
    hot = cut(counts.orderBy(F.desc("__n"), *keys).limit(HOT_KEYS).select(*[F.col(k).alias(n) for k, n in zip(keys, key_names, strict=True)], F.least(F.ceil(F.col("__n") / F.lit(HOT_ROWS)), F.lit(10_000)).cast("int").alias(parts)))
    if hot.isEmpty():
        return left.join(right, keys, how)

    def marked(df: DataFrame) -> DataFrame:
        on = F.lit(True)
        for k, n in zip(keys, key_names, strict=True):
            on = on & (F.col(k) == F.col(n))
        return df.join(F.broadcast(hot), on, "left").drop(*key_names)

    one = marked(left).withColumn(part, F.pmod(F.xxhash64(spread), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    two = marked(right).withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return one.join(two, [*keys, part], how).drop(part)
