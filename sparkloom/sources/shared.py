"""Tables written once in the folder that the cluster shares, so that what several branches of a plan read is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a new one only where none is named, on a local master."""
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written_once(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
