"""Functions that plain SQL calls give what the column helpers and DataFrame chunkers give."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import extension
from tessella.functions import text as T
from tessella.operators import chunking, rechunking


@pytest.fixture(scope="module")
def sql(spark):
    extension.register(spark)
    extension.register(spark)  # once more does no harm
    return spark.sql


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


TEXTS = [None, "", " ", "a-b__c/d  E\n", "Ünï cödé", "x" * 1201, "par one. " * 60 + "\n\n" + "par two! " * 200 + "\n", " " * 2500 + "z"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def test_text_helpers(spark, sql, docs):
    docs.createOrReplaceTempView("extension_docs")
    found = sql("SELECT doc_id, norm_text(text), plain_words(text), chunk_tokens(text), norm_title(text) FROM extension_docs")
    text = F.col("text")
    assert rows(found) == rows(docs.select("doc_id", T.normalize(text), T.plain_words(text), T.chunk_tokens(text), T.fold_title(text)))


def test_number_helpers(sql):
    row = sql("""SELECT unit_cosine(array(0.6D, 0.8D), array(0.8D, 0.6D)), unit_cosine(array(1D), array(-1D)), unit_cosine(NULL, array(1D)),
      bm25_idf(10, 1), bm25_idf(10, 9), bm25_weight(2, 30, 20D)""").first()
    assert row[0] == pytest.approx(0.96) and row[1] == 0 and row[2] is None
    assert row[3] == pytest.approx(1.845827) and row[4] == 1e-6 and row[5] == pytest.approx(2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 1.5)))


def test_fixed_chunks(sql, docs):
    docs.createOrReplaceTempView("extension_docs")
    found = sql("SELECT doc_id, c.chunk_number, c.text FROM extension_docs, LATERAL fixed_chunks(text, 700) AS c")
    assert rows(found) == rows(chunking.fixed_windows(docs, 700))


def test_paragraph_chunks(spark, sql, docs, sf_dir):
    docs.withColumn("extra", F.lit(1)).createOrReplaceTempView("extension_docs")
    assert rows(sql("SELECT * FROM paragraph_chunks(TABLE(extension_docs))")) == rows(chunking.paragraph_chunks(docs))
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole.createOrReplaceTempView("extension_all")
    found = rows(sql("SELECT * FROM paragraph_chunks(TABLE(SELECT doc_id, text FROM extension_all))"))
    assert found and found == rows(chunking.paragraph_chunks(whole))


def test_section_chunks(spark, sql, sf_dir):
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.split("text", "\n").alias("lines"))
    each = text.select("id", F.posexplode("lines").alias("n", "content")).withColumn("heading", F.when(F.col("n") % 3 == 0, F.concat(F.lit("Part "), F.col("n").cast("string"))))
    extra = spark.createDataFrame([("none", 0, "A", None), ("none", 1, "B", " "), ("one", 0, None, "y" * 1300), (None, 0, "N", "z" * 200)], "id string, n int, heading string, content string")
    sections = each.select("id", "n", "heading", "content").unionByName(extra)
    sections.createOrReplaceTempView("extension_sections")
    found = sql("SELECT * FROM section_chunks(TABLE(extension_sections) PARTITION BY id ORDER BY n)")
    given = {}
    for r in sections.orderBy("n").collect():
        given.setdefault(r.id, []).append({"heading": r.heading, "content": r.content})
    want = [(i, n, s, t) for i, parts in given.items() for n, (s, t) in enumerate(rechunking.split_document(None, None, parts, chunking.Options()))]
    assert rows(found) == sorted(want, key=repr) and len(want) > 100


def test_empty_tables(spark, sql, docs):
    docs.limit(0).createOrReplaceTempView("extension_none")
    assert rows(sql("SELECT * FROM paragraph_chunks(TABLE(extension_none))")) == []
    spark.createDataFrame([], "id string, n int, heading string, content string").createOrReplaceTempView("extension_no_sections")
    assert rows(sql("SELECT * FROM section_chunks(TABLE(extension_no_sections) PARTITION BY id ORDER BY n)")) == []
