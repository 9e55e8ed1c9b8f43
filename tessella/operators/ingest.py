"""Chunks of loose JSON checked before they are indexed: the first rule that each breaks, and what the index takes of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.records import metadata_fields, number_at, text_at, texts_at, texts_by_key, whole_at


def said_at(record: Column, name: str) -> Column:
    """A field as stripped text; zero, false, and empty lists and objects say nothing, as a missing field does."""
    value = F.try_variant_get(record, f"$.{name}", "variant")
    empty = (F.schema_of_variant(value) != "STRING") & text_at(record, name).isin("0", "false", "[]", "{}")
    return F.when(empty, "").otherwise(text_at(record, name))


def checked(rows: DataFrame, chunk: str = "chunk", line: str = "line") -> DataFrame:
    """Rows of a VARIANT `chunk` and a unique `line`, with id, text, content_hash, generation, chunk_number and error.

    error is the first rule that a chunk breaks, null for none: an object; an id; a text; a hash; the hash of the stripped text;
    whole numbers for generation and chunk_number; no earlier line, right otherwise, with the same id. A null chunk is no
    object. Which line is first is found by ids' least lines and joined back by line, so that a common id meets no one task.
    """
    c = F.col(chunk)
    fields = {"id": said_at(c, "id"), "text": said_at(c, "text"), "content_hash": said_at(c, "content_hash")}
    fields |= {"generation": whole_at(c, "generation"), "chunk_number": whole_at(c, "chunk_number")}
    error = (
        F.when(~F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False)), "chunk_must_be_an_object")
        .when(F.col("id") == "", "missing_chunk_id")
        .when(F.col("text") == "", "empty_text")
        .when(F.col("content_hash") == "", "missing_content_hash")
        .when(F.sha2("text", 256) != F.col("content_hash"), "content_hash_mismatch")
        .when(F.col("generation").isNull() | F.col("chunk_number").isNull(), "invalid_operational_metadata")
    )
    found = rows.select(line, chunk).withColumns(fields).withColumn("error", error)
    first = found.filter("error IS NULL").groupBy("id").agg(F.min(line).alias(line)).select(line, F.lit(True).alias("first"))
    again = F.when(F.col("error").isNull() & F.col("first").isNull(), "duplicate_chunk_id")
    return found.join(first, line, "left").withColumn("error", F.coalesce("error", again)).drop("first")


def prepared(found: DataFrame, chunk: str = "chunk", prefix: str = "") -> DataFrame:
    """What is indexed of checked rows without an error: the text under the prefix that the encoder wants, the document's own
    text, and its metadata, facts under qf_ keys. Years and ratings that are no numbers are null.
    """
    c = F.col(chunk)
    shown = {name: F.coalesce(F.try_variant_get(c, f"$.{name}", "string"), F.lit("")) for name in ("document_id", "title", "section", "url", "strategy")}
    return found.filter("error IS NULL").select(
        "id", F.concat(F.lit(prefix), "text").alias("text"), F.col("text").alias("document"), "content_hash", "generation", "chunk_number",
        *(value.alias(name) for name, value in shown.items()), F.array_join(texts_at(c, "genres"), ", ").alias("genres"),
        whole_at(c, "year").alias("year"), number_at(c, "imdb_rating").alias("imdb_rating"), metadata_fields(texts_by_key(c, "quick_facts")).alias("facts"),
    )


def report(found: DataFrame) -> DataFrame:
    """(error, n) by error; null counts the rows that pass."""
    return found.groupBy("error").agg(F.count("*").alias("n"))
