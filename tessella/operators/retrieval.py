"""Ranked lists: dense and sparse top-k, rank fusion, reranking, near-duplicates, diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.index import K1, LEAST_IDF, TOKEN, B, bounded
from tessella.storage import materialize, shared_folder

RRF_K = 60
#: Queries and rows are compared in blocks of so many, so that a block's scores fit a task.
QUERY_BLOCK, ROW_BLOCK = 512, 1 << 14
#: Texts are scored in blocks of so many or of so many tokens, a longer one alone; their counts in blocks of so many rows.
TEXT_BLOCK, TOKEN_BLOCK, COUNT_BLOCK = 1 << 12, 1 << 20, 1 << 13
#: Terms of queries are counted in blocks of so many.
TERM_BLOCK = 1 << 16


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", condition: Column | None = None) -> DataFrame:
    """(query_id, key, score, rank) of the k nearest rows by cosine for each query (query_id, vector), exactly.

    The condition is applied before the cut, so filtered searches return k rows where there are k. The stated set of queries
    is written to the shared folder; each task goes through it block by block with some thousand rows at once, and sends
    the k best of each query. Nothing passes through the driver, and the rows are read once. Null vectors match nothing.
    """
    rows = vectors.filter(condition) if condition is not None else vectors
    rows = rows.select(key, vector).filter(F.col(vector).isNotNull())
    folder = shared_folder(rows.sparkSession, "query-vectors")
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    asked.write.parquet(folder)
    found = rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    best = found.mapInArrow(lambda batches: _nearest(batches, folder, k), f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _unit(column: pa.Array) -> np.ndarray:
    matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def _nearest(batches: Iterator[pa.RecordBatch], folder: str, k: int) -> Iterator[pa.RecordBatch]:
    names = None
    held: list[pa.RecordBatch] = []
    for batch in batches:
        names = ["query_id", batch.schema.names[0], "score"]
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROW_BLOCK:
            yield from _block_best(held, folder, k, names)
            held = []
    if held and sum(b.num_rows for b in held):
        yield from _block_best(held, folder, k, names)


def _block_best(held: list[pa.RecordBatch], folder: str, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The k best of a block of rows for each query, ties by key."""
    keys, rows = np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([_unit(b.column(1)) for b in held if b.num_rows])
    system, path = fs.FileSystem.from_uri(folder)
    for block in ds.dataset(path, filesystem=system, format="parquet").to_batches(batch_size=QUERY_BLOCK):
        if not block.num_rows:
            continue
        ids, scores = block.column("query_id").to_numpy(), np.clip(_unit(block.column("vector")) @ rows.T, 0, 1)
        if k < len(keys):
            least = np.partition(scores, len(keys) - k, axis=1)[:, len(keys) - k, None]
            query, row = np.nonzero(scores >= least - 1e-12)
        else:
            query, row = np.divmod(np.arange(scores.size), len(keys))
        # rounded, as equal vectors can differ in their last bits
        value = np.round(scores[query, row], 12)
        order = np.lexsort((keys[row], -value, query))
        query, row, value = query[order], row[order], value[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        few = place < k
        yield pa.RecordBatch.from_arrays([pa.array(ids[query[few]]), pa.array(keys[row[few]]), pa.array(value[few])], names=names)


def sparse_topk(texts: DataFrame, queries: DataFrame, k: int, key: str, text: str = "text", token: str = TOKEN, words: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank) of the k best texts by BM25 for each query (query_id, term), exactly; scores have nine
    places, ties go by key, and texts without a term of a query are not in its list.

    A token stands for itself, or with `words` (word, term; each word once) for its term. The terms that are asked for, then
    the queries with their terms' weights, are written to the shared folder. Tasks read texts twice: for how many hold a
    term, and, block by block, for scores, of which they send the k best of each query. Keys are unique. Neither postings
    nor scores of all pairs are shuffled or stored.
    """
    asked = queries.select("query_id", "term").filter("term IS NOT NULL").distinct()
    wanted = asked.select("term").distinct()
    meant = wanted.withColumn("word", F.col("term")) if words is None else words.join(wanted, "term").select("term", "word")
    terms, weights = (shared_folder(texts.sparkSession, label) for label in ("query-words", "query-weights"))
    meant.groupBy("term").agg(F.collect_list("word").alias("words")).write.parquet(terms)
    tokens = texts.select(key, F.regexp_extract_all(F.lower(text), F.lit(f"({token})"), 1).alias("tokens"))
    held = tokens.select("tokens").mapInArrow(lambda batches: _holders(batches, terms), "term string, n long, known long, tokens long")
    counts = materialize(held.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "known", "tokens"))), "term-counts")
    stats = counts.filter("term IS NULL").select(F.col("n").alias("texts"), (F.col("tokens") / F.col("known")).alias("avg_len"))  # one row
    frequent = counts.filter("term IS NOT NULL").select("term", "n")
    idf = F.greatest(F.log((F.col("texts") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    entries = asked.join(frequent, "term").join(meant, "term").crossJoin(F.broadcast(stats)).select("query_id", "avg_len", F.struct("term", "word", idf.alias("idf")).alias("entry"))
    entries.groupBy("query_id").agg(F.first("avg_len").alias("avg_len"), F.collect_list("entry").alias("entries")).write.parquet(weights)
    kinds = dict(asked.dtypes) | dict(tokens.dtypes)
    best = tokens.mapInArrow(lambda batches: _best_texts(batches, weights, k), f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double")
    return ranked_lists(best, key, k)


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(_sizes(batch.column("tokens")))
        start = 0
        while start < batch.num_rows:
            most = np.searchsorted(ends, (ends[start - 1] if start else 0) + TOKEN_BLOCK, "right")
            stop = max(start + 1, min(start + TEXT_BLOCK, int(most)))
            yield batch.slice(start, stop - start)
            start = stop


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def _blocks(folder: str, size: int) -> Iterator[pa.RecordBatch]:
    system, path = fs.FileSystem.from_uri(folder)
    return (b for b in ds.dataset(path, filesystem=system, format="parquet").to_batches(batch_size=size) if b.num_rows)


def _counted(tokens: pa.Array, words: pa.Array, meaning: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, how often) of lists of tokens, by row and term; meaning: each word's term, terms: their number."""
    word = pc.index_in(tokens.flatten(), value_set=words)
    known = word.is_valid().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(tokens)), _sizes(tokens))[known]
    pairs, times = np.unique(rows * terms + meaning[word.drop_null().to_numpy()], return_counts=True)
    return *np.divmod(pairs, terms), times


def _holders(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """(term, n, null, null): how many texts of a block hold a term that is asked for; by the term null (null, texts, texts that are not null, tokens)."""
    names = ["term", "n", "known", "tokens"]
    for batch in _text_blocks(batches):
        tokens = batch.column("tokens")
        size = len(tokens), len(tokens) - tokens.null_count, int(_sizes(tokens).sum())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *(pa.array([n], pa.int64()) for n in size)], names=names)
        for block in _blocks(folder, TERM_BLOCK):
            words = block.column("words")
            _, term, _ = _counted(tokens, words.flatten(), np.repeat(np.arange(block.num_rows), _sizes(words)), block.num_rows)
            term, n = np.unique(term, return_counts=True)
            yield pa.RecordBatch.from_arrays([block.column("term").take(pa.array(term)), pa.array(n, pa.int64()), *[pa.nulls(len(n), pa.int64())] * 2], names=names)


def _best_texts(batches: Iterator[pa.RecordBatch], folder: str, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a block of texts for each query, ties by key."""
    for batch in _text_blocks(batches):
        keys, tokens = batch.column(0), batch.column("tokens")
        place = np.empty(len(keys), np.int64)
        place[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
        for block in _blocks(folder, QUERY_BLOCK):
            query, row, value = _firsts(_bm25(tokens, block), place, k)
            yield pa.RecordBatch.from_arrays([block.column("query_id").take(pa.array(query)), keys.take(pa.array(row)), pa.array(value)], names=["query_id", batch.schema.names[0], "score"])


def _bm25(tokens: pa.Array, queries: pa.RecordBatch) -> np.ndarray:
    """Scores of each query (a row) for each text."""
    lists = queries.column("entries")
    entries, asker = lists.flatten(), np.repeat(np.arange(len(lists)), _sizes(lists))
    words, terms = (pc.dictionary_encode(entries.field(f)) for f in ("word", "term"))
    n, term = len(terms.dictionary), terms.indices.to_numpy()
    meaning = np.empty(len(words.dictionary), np.int64)
    meaning[words.indices.to_numpy()] = term
    idf = np.zeros((n, len(lists)))
    idf[term, asker] = entries.field("idf").to_numpy()
    row, term, tf = _counted(tokens, words.dictionary, meaning, n)
    share = _sizes(tokens)[row] / queries.column("avg_len")[0].as_py()
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * share))
    scores = np.zeros((len(tokens), len(lists)))
    held, first = np.unique(row, return_index=True)
    first = np.append(first, len(row))
    start = 0
    while start < len(held):
        stop = max(start + 1, int(np.searchsorted(first, first[start] + COUNT_BLOCK, "right")) - 1)
        part = slice(first[start], first[stop])
        scores[held[start:stop]] = np.add.reduceat(idf[term[part]] * weight[part, None], first[start:stop] - first[start], axis=0)
        start = stop
    return scores.T


def _firsts(scores: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score to nine places) of the k highest scores over zero of each row, of equal ones the first by the columns' place."""
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None] if k < scores.shape[1] else 0.0
    row, column = np.nonzero((scores > 0) & (scores >= least - 1e-9))
    value = np.round(scores[row, column], 9)
    order = np.lexsort((place[column], -value, row))
    row, column, value = row[order], column[order], value[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[few], column[few], value[few]


def ranked_lists(scores: DataFrame, key: str, k: int, group: str = "query_id") -> DataFrame:
    """Scores as lists of k, ranked by score, then key."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int = RRF_K, group: str = "query_id") -> DataFrame:
    """(group, key, rrf) summed over the lists' ranks."""
    rows = reduce(DataFrame.unionByName, [x.select(group, key, "rank") for x in lists])
    return rows.groupBy(group, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def overlaid(lists: list[DataFrame], keys: list[str], ranks: list[str], k: int = RRF_K) -> DataFrame:
    """Lists of candidates merged by key: of each field the last value that is not null, fields that one list has alone
    beside them, and rrf over the columns `ranks`, where a missing rank adds nothing.

    Lists hold a row for each key. Every list shuffles once by key, whatever its fields.
    """

    def merge(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in left.columns if c in right.columns and c not in keys]
        both = left.join(right.withColumnsRenamed({c: f"_later_{c}" for c in shared}), keys, "full")
        return both.withColumns({c: F.coalesce(f"_later_{c}", c) for c in shared}).drop(*(f"_later_{c}" for c in shared)) if shared else both

    parts = [F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0)) for r in ranks]
    return reduce(merge, lists).withColumn("rrf", reduce(lambda a, b: a + b, parts))


def fuse_attempts(attempts: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """One list from several attempts (attempt, key, rank, score, rerank_score): fused scores to eight places, and of each
    item the strongest appearance, the earliest among equals.
    """
    lowest = F.lit(float("-inf"))
    strength = F.struct(F.coalesce("rerank_score", lowest), F.coalesce("score", lowest), -F.col("attempt"))
    fused = attempts.groupBy(key).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("f"), F.max_by(F.struct("attempt", "rank", "score", "rerank_score"), strength).alias("best")
    )
    return fused.select(key, F.round("f", 8).alias("fused"), "best.*")


def diverse(rows: DataFrame, document: str, key: str, order: list[Column], most: int, group: list[str]) -> DataFrame:
    """The first rows of each document within a group; a missing document counts as the row's own."""
    owner = F.coalesce(F.nullif(F.col(document).cast("string"), F.lit("")), F.col(key).cast("string"))
    number = F.row_number().over(Window.partitionBy(*group, owner).orderBy(*order))
    return rows.withColumn("_number", number).filter(F.col("_number") <= most).drop("_number")


def similar_texts(a: str, b: str, ratio: float = 0.8) -> bool:
    """Equal, or one within the other with lengths that differ little."""
    short, long = sorted((a, b), key=len)
    return a == b or (bool(long) and len(short) / len(long) >= ratio and short in long)


def without_near_duplicates(ranked: DataFrame, key: str, group: str = "query_id", ratio: float = 0.8) -> DataFrame:
    """Ranked lists (group, rank, key, text) without rows near one that was kept; lists are short, a group each."""
    schema = ranked.schema

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[str] = []
        take = []
        rows = rows.sort_values(["rank", key])
        for text in rows["text"]:
            take.append(not any(similar_texts(text or "", k, ratio) for k in kept))
            if take[-1]:
                kept.append(text or "")
        return rows[np.array(take, dtype=bool)]

    return ranked.groupBy(group).applyInPandas(greedy, schema)


Reranker = Callable[[list[str], list[str]], list[float]]


def overlap_scores(queries: list[str], texts: list[str]) -> list[float]:
    """The offline default reranker: +3 where a text holds any token of its query, else -3."""
    return [3.0 if set(q.lower().split()) & set(t.lower().split()) else -3.0 for q, t in zip(queries, texts, strict=True)]


def rerank(rows: DataFrame, query: str, text: str, score: Reranker = overlap_scores) -> DataFrame:
    """`rows` with rerank_score, by a scorer of lists of pairs in Arrow batches."""

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(score(q.fillna("").tolist(), t.fillna("").tolist()), index=q.index)

    return rows.withColumn("rerank_score", scored(F.col(query), F.col(text)))


def hybrid(dense: DataFrame, sparse: DataFrame, chunks: DataFrame, queries: DataFrame, key: str, document: str, top: int = 30, final: int = 5, per_document: int = 2) -> DataFrame:
    """Dense and sparse lists fused, the best reranked by the query's own text, near-duplicates dropped, documents capped."""
    fused = reciprocal_rank_fusion([dense, sparse], key).withColumnRenamed("rrf", "score")
    # stored, so that what is broadcast to the chunks is known to be small, and their texts are not shuffled
    candidates = materialize(ranked_lists(fused, key, top).select("query_id", key, F.col("score").alias("rrf")), "candidates")
    texts = bounded(candidates).join(chunks.select(key, document, "text"), key).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    scored = rerank(texts, "query", "text").withColumn("score", 1 / (1 + F.exp(-F.col("rerank_score"))))
    order = [F.desc("score"), F.desc("rrf"), F.col(document), F.col(key)]
    ordered = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    few = diverse(without_near_duplicates(ordered, key), document, key, [F.col("rank")], per_document, ["query_id"])
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return few.withColumn("rank", number).filter(F.col("rank") <= final).select("query_id", key, document, "rrf", "score", "rank")


def strength(rows: DataFrame, attempt: str) -> DataFrame:
    """Attempts by how strong their best row is: rerank score, then score, missing ones last; one row each."""
    lowest = F.lit(float("-inf"))
    best = F.max(F.struct(F.coalesce("rerank_score", lowest).alias("rerank_score"), F.coalesce("score", lowest).alias("score")))
    return rows.groupBy(attempt).agg(best.alias("best"), F.count("*").alias("n")).select(attempt, "best.*", "n")


def relaxed(filtered: DataFrame, unfiltered: DataFrame, group: str = "query_id") -> DataFrame:
    """Each query's filtered rows, or its unfiltered ones, marked, where the filters leave none."""
    rest = unfiltered.join(filtered.select(group).distinct(), group, "left_anti")
    return filtered.withColumn("relaxed", F.lit(False)).unionByName(rest.withColumn("relaxed", F.lit(True)))
