"""What plain SQL can call: helper functions as SQL functions, chunkers as table functions.

`register(spark)` makes them temporary functions of the session. The helpers and fixed_chunks are SQL throughout, so that the
optimizer inlines them; the two other chunkers run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from tessella.functions.text import fold_title
from tessella.operators.chunking import Options, pack_paragraphs
from tessella.operators.rechunking import split_document

SQL_FUNCTIONS = (
    r"""norm_text(body STRING) RETURNS STRING
    RETURN lower(trim(regexp_replace(regexp_replace(body, r'[-_/]+', ' '), r'\s+', ' ')))""",
    r"""plain_words(body STRING) RETURNS STRING
    RETURN trim(regexp_replace(lower(body), r'[^a-z0-9]+', ' '))""",
    """chunk_tokens(body STRING) RETURNS BIGINT
    RETURN ceil(char_length(body) / 4)""",
    """unit_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
    RETURN if(a IS NULL OR b IS NULL, NULL, greatest(0D, least(1D, aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x))))""",
    """bm25_idf(texts BIGINT, holding BIGINT) RETURNS DOUBLE
    RETURN greatest(ln((texts - holding + 0.5D) / (holding + 0.5D)), 1e-6D)""",
    """bm25_weight(tf BIGINT, len BIGINT, avg_len DOUBLE) RETURNS DOUBLE
    RETURN tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * len / avg_len))""",
    """fixed_chunks(body STRING, width INT) RETURNS TABLE (chunk_number INT, text STRING)
    RETURN SELECT n, part FROM (
      SELECT p.n, substring(body, p.n * width + 1, width) AS part FROM (SELECT explode(sequence(0, greatest(char_length(body) - 1, 0) DIV width)) AS n) AS p)
    WHERE trim(part) <> ''""",
)

OPTIONS = Options()


@arrow_udtf(returnType="doc_id bigint, chunk_number int, text string")
class ParagraphChunks:
    """paragraph_chunks(TABLE(doc_id, text)): packed paragraphs of each row, without those under the least size, then numbered.

    Needs no partitioning: a row is a whole text. A null text has no chunk.
    """

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        found = []
        for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
            chunks = [c for c in pack_paragraphs(text or "", OPTIONS) if len(c) >= OPTIONS.least]
            found += [(doc, i, c) for i, c in enumerate(chunks)]
        ids, numbers, texts = zip(*found, strict=True) if found else ((), (), ())
        yield pa.table({"doc_id": pa.array(ids, pa.int64()), "chunk_number": pa.array(numbers, pa.int32()), "text": pa.array(texts, pa.string())})


@arrow_udtf(returnType="id string, pos int, section string, text string")
class SectionChunks:
    """section_chunks(TABLE(id, heading, content) PARTITION BY id ORDER BY ...): a document's sections, one a row, as chunks.

    Takes the sections in the order given; a document with one section, or none with content, is split as one text. What is
    held is one document at a time. Documents with a null id are one document.
    """

    def __init__(self) -> None:
        self.id: str | None = None
        self.sections: list[dict] = []

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        named = rows.select(["heading", "content"])
        if named.num_rows:
            self.id = rows.column("id")[0].as_py()
            self.sections += named.to_pylist()
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        chunks = split_document(None, None, self.sections, OPTIONS)
        sections, texts = zip(*chunks, strict=True) if chunks else ((), ())
        n = len(chunks)
        yield pa.table({
            "id": pa.array([self.id] * n, pa.string()), "pos": pa.array(range(n), pa.int32()), "section": pa.array(sections, pa.string()), "text": pa.array(texts, pa.string()),
        })


def register(spark: SparkSession) -> None:
    """Make all functions of this module, and norm_title, known to a session's SQL; once more does no harm."""
    for body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    spark.udf.register("norm_title", fold_title)
    spark.udtf.register("paragraph_chunks", ParagraphChunks)
    spark.udtf.register("section_chunks", SectionChunks)
