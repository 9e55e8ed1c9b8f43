"""Index build: chunks to postings and vectors, reusing cached vectors and dropping what is stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import index


def chunk_errors(chunks: DataFrame) -> DataFrame:
    """Chunks with the first thing wrong with them, null for none."""
    wrong = (
        F.when(F.coalesce("id", F.lit("")) == "", "missing_id")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "missing_text")
        .when(F.sha2("text", 256) != F.col("content_hash"), "content_hash_mismatch")
    )
    return chunks.withColumn("error", wrong)


def build(chunks: DataFrame, cache: DataFrame | None = None, existing: DataFrame | None = None, encode: index.Encoder | None = None) -> dict[str, DataFrame]:
    """postings, lengths, vectors, cache, errors and stale (ids indexed before that have no chunk now).

    Vectors are looked up by content hash; each distinct text that is missing is encoded once.
    """
    checked = chunk_errors(chunks)
    good = checked.filter("error IS NULL").dropDuplicates(["id"])
    wanted = good.groupBy("content_hash").agg(F.min("text").alias("text"))
    known = cache if cache is not None else wanted.limit(0).select("content_hash", F.array().cast("array<float>").alias("vector"))
    status = index.cache_status(wanted, known.select("content_hash", "vector"), ["content_hash"])
    fresh = index.embed(status.filter("status = 'miss'").select("content_hash", "text"), "content_hash", "text", encode)
    vectors = status.filter("status = 'hit'").select("content_hash", "vector").unionByName(fresh)
    dense = good.select("id", "content_hash").join(vectors, "content_hash")
    gone = index.stale(existing, good, "id") if existing is not None else good.select("id").limit(0)
    return {
        "postings": index.postings(good, "id"), "lengths": index.text_lengths(good, "id"), "vectors": dense, "cache": index.upsert(known, fresh, "content_hash"),
        "errors": checked.filter("error IS NOT NULL").select("id", "error"), "stale": gone,
    }


def parity(vectors: DataFrame, lengths: DataFrame) -> bool:
    """Whether both indexes hold the same ids."""
    return vectors.select("id").exceptAll(lengths.select("id")).isEmpty() and lengths.select("id").exceptAll(vectors.select("id")).isEmpty()
