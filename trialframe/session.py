"""SparkSession factory and cluster-facing settings.

Everything scale-related lives here so a job can be re-tuned without touching
operators: AQE (runtime re-planning, partition coalescing, skew-join
splitting), a size-checked broadcast threshold, and the shared checkpoint
folder used to cut long lineage.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours should carry. AQE converts a sort-merge join
# into a broadcast join only after it has *measured* the small side, and splits
# a skewed shuffle partition of the big side into several tasks.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keep pivots on an explicit value list; never let pivot run a distinct job
    "spark.sql.pivotMaxValues": "10000",
}


def build_session(
    master: str = "local[8]",
    app_name: str = "trialframe",
    shuffle_partitions: int = 8,
    extra: dict | None = None,
) -> SparkSession:
    """Local/test session. On a cluster, use the session the platform gives
    you and call :func:`apply_scale_conf` on it instead."""
    b = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TF_DRIVER_MEMORY", "16g"))
    )
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_scale_conf(spark: SparkSession) -> SparkSession:
    for k, v in SCALE_CONF.items():
        spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the platform must set it to shared storage: executors do not
    see a folder of the driver's machine. Only a ``local`` master, where they
    are one machine, gets a fresh scratch folder when it is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="trialframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (survives executor loss,
    unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
