"""Session helpers: a sane local session for tests/bench, and the shared
checkpoint folder used to cut lineage in iterative operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "shopsight") -> SparkSession:
    """Local session for tests and benchmarks.  On a cluster, build the session
    with the cluster's own settings instead; every operator only needs AQE and a
    UTC session time zone."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # HotSpot does not JIT methods above 8000 bytes; a fused stage whose
        # generated method is larger would run interpreted.  With this limit
        # such subtrees fall back to (JIT-compiled) expression evaluation.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", os.environ.get("SHOPSIGHT_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, which sees its own folders."""
    return master.split("[")[0] == "local"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, honouring ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder and is used as is; unset, it
    is an error there.  Local mode (tests) gets a private scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="shopsight-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
