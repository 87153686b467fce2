"""Session settings the jobs rely on, and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. Shuffle partition counts are left to the cluster: AQE coalesces them.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys: AQE splits the map blocks of an oversized join partition over many tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A repeated JSON key keeps its last value instead of failing the row.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Payloads are read whole, and no two need have the same members: shredding them costs on every cut, and again on every read.
    "spark.sql.variant.inferShreddingSchema": "false",
    # Inferring constraints over projections with hundreds of payload expressions takes the optimizer
    # minutes; filters that matter are written out.
    "spark.sql.constraintPropagation.enabled": "false",
    # Rows handed to Python at once; whole texts can be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Replacing a daily table rewrites only the dates present in the output.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Applies the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tideline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the one the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _stage_dir(spark: SparkSession) -> str:
    return join_path(shared_dir(spark), "tideline-stage", spark.sparkContext.applicationId)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own among this application's cuts."""
    return join_path(_stage_dir(spark), uuid.uuid4().hex)


def cut(df: DataFrame) -> DataFrame:
    """Writes an intermediate result to the shared folder and reads it back without its lineage.

    A lost executor costs a re-read, not a recomputation, and the planner sees the true size, so it
    broadcasts what is small. All cuts of an application lie in one folder; see drop_cuts.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Removes this application's cuts once nothing reads them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_path(base: str, *parts: str) -> str:
    return os.path.join(base, *parts)
