"""Sparse and dense indexes as ordinary tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.stemming import term_dictionary
from tessella.functions.text import norm
from tessella.storage import materialize

K1, B = 1.2, 0.75
#: A term that most texts hold still counts a little.
LEAST_IDF = 1e-6
TOKEN = "[a-z0-9]+"


#: Letters, digits and the accents on them, in any script.
WORD = r"[\p{L}\p{N}\p{Co}\p{Mn}]+"
#: So many terms or texts, at most, are broadcast; more of them shuffle.
BROADCAST_TERMS = 200_000


def bounded(frame: DataFrame) -> DataFrame:
    """A stored frame with a broadcast hint where it has few rows."""
    return F.broadcast(frame) if frame.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else frame


def postings(texts: DataFrame, key: str, text: str = "text", only: DataFrame | None = None, token: str = TOKEN) -> DataFrame:
    """(key, len, term, tf) of tokens, lower-cased, unstemmed, with the text's number of tokens; keys are unique.

    Write it bucketed by term to probe few terms often. With `only` (a column term), tokens of other terms are dropped
    before anything is shuffled.
    """
    terms = F.regexp_extract_all(F.lower(text), F.lit(f"({token})"), 1)
    tokens = texts.select(key, terms.alias("terms")).select(key, F.size("terms").cast("long").alias("len"), F.explode("terms").alias("term"))
    if only is not None:
        tokens = tokens.join(bounded(only.select("term").distinct()), "term", "left_semi")
    return tokens.groupBy(key, "len", "term").agg(F.count("*").alias("tf"))


def stemmed_postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, len, term, tf) with stems for terms: words of any script, without accents, English ones by Porter's rules.

    Words are counted by text first and written; each distinct one is stemmed once, and the counts meet the stems by word.
    """
    counted = materialize(postings(texts, key, text, token=WORD), "posted-words")
    words = materialize(term_dictionary(counted), "term-dictionary")
    stems = counted.join(bounded(words), "term").drop("term").withColumnRenamed("stem", "term")
    return stems.groupBy(key, "len", "term").agg(F.sum("tf").alias("tf"))


def word_stems(texts: DataFrame, only: DataFrame, text: str = "text") -> DataFrame:
    """(word, term) of each distinct word of the texts whose stem is a term of `only` (a column term)."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)).alias("term"))
    # stored, as Spark would push the join, and with it the stemmer, below the distinct words
    stems = materialize(term_dictionary(words), "term-dictionary").select(F.col("term").alias("word"), F.col("stem").alias("term"))
    return stems.join(bounded(only.select("term").distinct()), "term", "left_semi").select("word", "term")


def text_lengths(texts: DataFrame, key: str, text: str = "text", token: str = TOKEN) -> DataFrame:
    return texts.select(key, F.regexp_count(F.lower(text), F.lit(token)).cast("long").alias("len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: the number of texts and their mean length."""
    return lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def bm25_scores(posted: DataFrame, lengths: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) of texts that hold any term of a query (query_id, term, distinct).

    Postings are read twice and texts' lengths once: give stored ones. Query terms are broadcast where they are few; what
    is shuffled is the scores of terms met, by query and text.
    """
    stats = F.broadcast(corpus_stats(lengths))  # one row
    terms = bounded(queries.select("term").distinct())
    frequent = term_stats(posted.join(terms, "term", "left_semi"))
    wanted = queries.join(frequent, "term").join(stats)
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    asked = materialize(wanted.select("query_id", "term", idf.alias("idf"), "avg_len"), "query-terms")
    hit = posted.join(bounded(asked), "term")
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hit.groupBy("query_id", key).agg(F.sum(F.col("idf") * weight).alias("score"))


def vector_errors(vectors: DataFrame, column: str, size: int, tolerance: float = 1e-3) -> DataFrame:
    """Rows with the first thing wrong with their vector, null for none."""
    v = F.col(column)
    length = norm(v)
    wrong = (
        F.when(v.isNull(), "missing_vector")
        .when(F.size(v) != size, "wrong_dimension")
        .when(~F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), "not_finite")
        .when(length == 0, "zero_vector")
        .when(F.abs(length - 1) > tolerance, "not_normalised")
    )
    return vectors.withColumn("error", wrong)


def hash_vector(text: str) -> list[float]:
    """The offline default encoder: four numbers of the text's SHA-256, as a unit vector."""
    numbers = [b + 1 for b in hashlib.sha256(text.encode()).digest()[:4]]
    size = math.sqrt(sum(x * x for x in numbers))
    return [x / size for x in numbers]


Encoder = Callable[[list[str]], list[list[float]]]


def embed(rows: DataFrame, key: str, text: str, encode: Encoder | None = None) -> DataFrame:
    """(key, vector) by an encoder of lists of texts, in Arrow batches."""
    run = encode or (lambda texts: [hash_vector(t) for t in texts])

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors = run([t or "" for t in part[text]])
            yield pd.DataFrame({key: part[key], "vector": [np.asarray(v, np.float32) for v in vectors]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(batch, f"{key} {kind}, vector array<float>")


def cache_status(chunks: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with their cached vector or null, and hit or miss."""
    found = chunks.join(cache.withColumn("_cached", F.lit(True)), keys, "left")
    return found.withColumn("status", F.when(F.col("_cached"), "hit").otherwise("miss")).drop("_cached")


def stale(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return existing.join(current.select(key), key, "left_anti")


def upsert(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows, and existing ones that have none."""
    return stale(existing, fresh, key).unionByName(fresh, allowMissingColumns=True)
