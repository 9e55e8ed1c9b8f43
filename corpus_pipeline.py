"""A corpus pipeline: five stages over documents, each calling one operator, each one's rows written and read again.

toxicity drops the documents that the classifier rejects; near_duplicates keeps one document of each group (five-word
shingles, similarity 0.8); decontamination drops documents with a benchmark passage; personal_data replaces what it finds in
the text; pieces encodes what is left and checks that decoding gives it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, minhash, personal, pieces, toxicity
from tessella.storage import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = personal.redact(docs, personal.fit(docs))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = pieces.round_trips(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "text_sha256", "lossless")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("pieces", encode_pieces),
]

#: The classifier, the random field and the sampled pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
