"""Tables kept between the steps of a job of several rounds, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder, so that later rounds neither compute it again nor depend on executors.

    The folder is that of spark.checkpoint.dir. Where it is unset, one of our own on a local master, as in tests; an error on
    a cluster, whose executors would not see it. Spark's cleaner removes the files once nothing reads them, if it is asked to
    (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="pointmill-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
