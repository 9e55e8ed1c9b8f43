"""The append-only query log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.storage import shared_folder
from tessella.streaming import upserts


def daily(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Counts and sums by day and kind of a streaming log; in append mode a day comes out once it is past the watermark."""
    timed = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    counts = timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counts.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def once_per_event(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A streaming log without repeats of an event within the lateness."""
    return log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the daily counts over what the log's folder holds.

    Each batch sends the days that changed, which replace theirs in a table; days past the watermark leave the state.
    """
    base = shared_folder(spark, "counts")
    upserts.start(daily(_log(spark, sf_dir)), base, ["day", "event_type"], ["n"], "update").awaitTermination()
    return upserts.table(spark, base, "day date, event_type string, n long, total double")


def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and kind by a stream that merges each batch of the log into a table."""
    base = shared_folder(spark, "last")
    events = _log(spark, sf_dir).select("user_id", "event_type", "event_id", "ts", "value")
    upserts.start(events, base, ["user_id", "event_type"], ["ts", "event_id"]).awaitTermination()
    return upserts.table(spark, base, "user_id long, event_type string, event_id long, ts timestamp, value double")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else f"{sf_dir}/events*.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file system has a folder at the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
