"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.session import prepare


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new URI below spark.checkpoint.dir for one run of a job.

    Its files stay until the cluster clears its checkpoint folder: results are lazy and may be read later.
    """
    prepare(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir names no folder; executors need one that all of them share")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: lineage ends at files that outlive any executor."""
    spark = frame.sparkSession
    path = shared_folder(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
