"""Streams into tables of one row a key: the last one wins, and a batch that is run again changes nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessella.jobs import manifest, publish
from tessella.operators.relational import last_wins

BUCKETS = 64


def start(stream: DataFrame, base: str, keys: list[str], order: list[str], mode: str = "append", buckets: int = BUCKETS) -> StreamingQuery:
    """Merge each batch of a stream into the table at `base`; run until what is there has been read.

    The checkpoint lies beside the table, so that a restart goes on where both stand.
    """
    spark = stream.sparkSession
    merge = lambda batch, number: apply(spark, batch, base, keys, order, number, buckets)
    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(merge).trigger(availableNow=True).start()


def apply(spark: SparkSession, batch: DataFrame, base: str, keys: list[str], order: list[str], number: int, buckets: int = BUCKETS) -> bool:
    """Merge one batch and publish it as a generation with the batch's number; False where that number is merged already.

    Of a key's rows the greatest by `order` stays; among equal ones that of the later batch, then the greatest as JSON.
    Nulls are least; null keys are a key. Rows lie in buckets by key: only buckets that the batch meets are written again,
    the manifest goes on naming the others. `buckets` counts from the first batch on; later ones keep that number. A writer
    that another one overtook gets Conflict, and its batch is to run again.
    """
    before = publish.current(spark, base)
    if before and before["batch"] >= number:
        return False
    buckets = before["buckets"] if before else buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    fresh = batch.withColumn("_bucket", bucket).withColumn("_batch", F.lit(number).cast("long"))
    # reduced before it is stored, and stored since it is read twice: for the buckets that it meets, and to be merged
    generation = (before["generation"] if before else 0) + 1
    folder = f"{base.rstrip('/')}/gen-{generation}-{uuid.uuid4().hex}"
    try:
        _last(fresh, keys, order, batch.columns).write.parquet(f"{folder}/batch")
        fresh = spark.read.schema(fresh.schema).parquet(f"{folder}/batch")
        met = {str(row["_bucket"]) for row in fresh.select("_bucket").distinct().collect()}  # at most `buckets` numbers
        kept = {name: path for name, path in (before["tables"] if before else {}).items()}
        old = [kept[name] for name in met if name in kept]
        if old:
            stored = spark.read.schema(fresh.drop("_bucket").schema).parquet(*old).withColumn("_bucket", bucket)
            fresh = _last(fresh.unionByName(stored), keys, order, batch.columns)
        fresh.repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{folder}/table")
        kept |= {name: f"{folder}/table/_bucket={name}" for name in met}
        named = {"generation": generation, "folder": folder, "tables": kept, "buckets": buckets, "batch": number, "schema": batch.schema.jsonValue()}
        publish.claim_next(spark, base, named)
    except BaseException:
        manifest.remove(spark, folder)
        raise
    manifest.remove(spark, f"{folder}/batch")
    return True


def table(spark: SparkSession, base: str, schema: str | None = None) -> DataFrame:
    """The rows of the current generation; with nothing published, none, of the schema given."""
    named = publish.current(spark, base)
    if named is None:
        if schema is None:
            raise ValueError(f"nothing is published in {base}")
        return spark.createDataFrame([], schema)
    kind = StructType.fromJson(named["schema"])
    if not named["tables"]:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(*named["tables"].values())


def _last(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    rank: list[Column] = [F.struct(*order).alias("o"), F.col("_batch"), F.to_json(F.struct(*columns)).alias("j")]
    return last_wins(rows, [*keys], rank).select(*rows.columns)
