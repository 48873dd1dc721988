"""Tables written to the folder that driver and executors share, to cut lineage
and to compute a costly step once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_FOLDER = "shopsight-llm"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Unset, a scratch folder serves
    in local mode only; on a cluster that is an error."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"set {_KEY} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shopsight-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again.  Executors
    that are lost later cost nothing but the reading."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_FOLDER}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every table that ``written`` left in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_FOLDER}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
