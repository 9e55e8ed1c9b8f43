"""Checks of loose chunks before they are indexed."""

import hashlib
import json

from pyspark.sql import functions as F

from tessella.operators import ingest


def chunk(**fields):
    text = fields.get("text", "a text")
    return {"id": "a", "text": text, "content_hash": hashlib.sha256(str(text).strip().encode()).hexdigest(), "generation": 1, "chunk_number": 0} | fields


def checked(spark, *chunks):
    rows = spark.createDataFrame([(i, c if c is None or isinstance(c, str) else json.dumps(c)) for i, c in enumerate(chunks)], "line long, j string")
    return ingest.checked(rows.select("line", F.try_parse_json("j").alias("chunk")).withColumn("error", F.lit("clash")))


def test_first_broken_rule(spark):
    given = [
        (None, "chunk_must_be_an_object"), ([1], "chunk_must_be_an_object"), ("not json", "chunk_must_be_an_object"),
        (chunk(id=" "), "missing_chunk_id"), (chunk(id=0), "missing_chunk_id"), (chunk(id=None, text=""), "missing_chunk_id"),
        (chunk(text=" \n"), "empty_text"), (chunk(text=None), "empty_text"), (chunk(text=[]), "empty_text"),
        (chunk(content_hash=""), "missing_content_hash"), (chunk(content_hash="0" * 64), "content_hash_mismatch"),
        (chunk(generation=None), "invalid_operational_metadata"), (chunk(chunk_number="x"), "invalid_operational_metadata"),
        (chunk(chunk_number="1.5"), "invalid_operational_metadata"), (chunk(chunk_number=[1]), "invalid_operational_metadata"),
        (chunk(id="b", text=" stripped \n", generation=" 2 ", chunk_number=3.7), None), (chunk(id=7), None), (chunk(id="b"), "duplicate_chunk_id"), (chunk(id=" b "), "duplicate_chunk_id"),
        (chunk(id="0"), None),
    ]
    found = checked(spark, *(c for c, _ in given)).orderBy("line").collect()
    assert [r.error for r in found] == [want for _, want in given]
    assert (found[15].text, found[15].generation, found[15].chunk_number, found[16].id) == ("stripped", 2, 3, "7")


def test_first_line_of_an_id_is_the_first_right_one(spark):
    found = checked(spark, chunk(content_hash="bad"), chunk(), chunk())
    assert [r.error for r in found.orderBy("line").collect()] == ["content_hash_mismatch", None, "duplicate_chunk_id"]
    assert {r.error: r.n for r in ingest.report(found).collect()} == {"content_hash_mismatch": 1, None: 1, "duplicate_chunk_id": 1}


def test_prepared_metadata(spark):
    facts = {"Run time": "1 h", "none": None, "n": 3, "l": [1]}
    found = checked(spark, chunk(id="full", title="T", genres=["a", "b"], year="1999", imdb_rating=7.5, quick_facts=facts, document_id="d"), chunk(id="bare", quick_facts="text"), chunk(id=""))
    rows = {r.id: r for r in ingest.prepared(found, prefix="passage: ").collect()}
    assert set(rows) == {"full", "bare"}
    full, bare = rows["full"], rows["bare"]
    assert (full.text, full.document, full.title, full.genres, full.year, full.imdb_rating, full.document_id) == ("passage: a text", "a text", "T", "a, b", 1999, 7.5, "d")
    assert full.facts == {"qf_run_time": "1 h", "qf_n": "3", "qf_l": "[1]"}
    assert (bare.title, bare.genres, bare.year, bare.facts) == ("", "", None, {})


def test_empty_table(spark):
    none = spark.createDataFrame([], "line long, j string").select("line", F.try_parse_json("j").alias("chunk"))
    assert ingest.prepared(ingest.checked(none)).count() == 0
