"""Session helpers: a tuned local session for tests/bench and cluster-safe scratch paths."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session should carry; on a cluster the deployment supplies the rest.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerlens") -> SparkSession:
    """Return the active session or build one (local mode in tests and bench)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str = "/tmp/ledgerlens-checkpoints") -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; a local master (tests) falls back to a
    folder of this machine, a cluster without the setting is an error."""
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        cur = fallback
        spark.conf.set("spark.checkpoint.dir", cur)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(cur)
    return cur


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerlens/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing Parquet to the shared checkpoint folder and reading it back.

    Survives executor loss (the data lives on shared storage, unlike a local checkpoint)
    and lets every later action start from a compact columnar table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (set from the session's
    ``spark.checkpoint.dir`` when the context has none yet); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as a columnar copy in the shared checkpoint folder, whatever its columns are called: later scans
    read only the columns they need. Types that Parquet can't hold are checkpointed as rows."""
    kinds = df.schema.simpleString()
    if not df.columns or "void" in kinds or "interval" in kinds:
        return checkpointed(df)
    return materialize(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), name).toDF(*df.columns)
