"""Session settings the library relies on, and the folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REQUIRED = {
    # Times are compared and cut in one zone.
    "spark.sql.session.timeZone": "UTC",
    # A repeated key of a JSON document: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # A repeated key of a key=value text: the last one counts.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Names are ASCII; plain case mapping gives the same result for them, and faster.
    "spark.sql.icu.caseMappings.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on; sizes and memory stay with the cluster."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a temporary one for a local session; on a cluster the
    executors could not share it, so there that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="sluicework-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Give work that is heavy per row to all cores where the input has fewer splits.

    Input with at least as many splits as cores, so anything large, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session has written under the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
