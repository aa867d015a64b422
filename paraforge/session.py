"""Session construction and the shared checkpoint folder.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a shared folder;
nothing here overrides either. Local runs (tests, bench) get a session with AQE on, the UI off
and a checkpoint folder under a fresh temp dir.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale; all are plain Spark SQL confs.
SCALE_CONFS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hot keys (one conversation or document may hold a large share of rows) get split by AQE.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "paraforge") -> SparkSession:
    """Return the active session, or build a local one for tests and the bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("PARAFORGE_MASTER", "local[8]")
    parts = str(shuffle_partitions or os.environ.get("PARAFORGE_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.driver.memory", os.environ.get("PARAFORGE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="pf-wh-"))
    )
    for k, v in SCALE_CONFS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session; only when it is unset (local tests) is a
    fresh temp folder chosen and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    path = path or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="pf-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared checkpoint folder for a written table."""
    return os.path.join(checkpoint_dir(spark).rstrip("/"), f"{name}-{uuid.uuid4().hex[:12]}")


def apply_scale_confs(spark: SparkSession) -> None:
    """Make sure the adaptive settings are on for a session built elsewhere."""
    for k, v in SCALE_CONFS.items():
        if k.startswith("spark.sql.adaptive") and spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def materialise(df):
    """Write ``df`` once to the shared checkpoint folder and return the table read from there.

    A reliable checkpoint computes its input for the eager count and again for the file write
    unless the input is persisted, so the input is persisted (memory and disk) for the duration
    and released afterwards. The result's lineage starts at the checkpoint files."""
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return kept.checkpoint(eager=True)
    finally:
        kept.unpersist()


def write_once(df, name: str):
    """Write ``df`` as Parquet into the shared folder and return the table read from there: one
    computation for all branches that read it, and no lineage beyond it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark) -> None:
    """Have the driver's garbage collectors find the shuffles that no table refers to any more: Spark removes their files then, else
    only when the heap is full. For steps between which much has been shuffled."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
