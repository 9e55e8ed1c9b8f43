"""Registered queries of the catalog, text, retrieval and evaluation operators, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import extension
from tessella.functions import text as T
from tessella.operators import catalog, chunking, conversation, evaluation, golden, index, ingest, lookup, rechunking, records, relational, retrieval
from tessella.sources import pages as page_source
from tessella.storage import materialize
from tessella.streaming import querylog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# catalog: filters, lists, counts, ranks, groups


@register("""
SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS ordinal, total, total > 50 AS truncated
FROM (SELECT *, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 400000 AND o_orderdate IS NOT NULL)
ORDER BY o_orderkey LIMIT 50""")
def catalog_filter_list(spark, sf_dir):
    filters = catalog.Filters(equal={"o_orderstatus": "O"}, least={"o_totalprice": 400000}, known=("o_orderdate",))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate").filter(filters.condition())
    return catalog.listed(rows.select("o_orderkey", "o_totalprice"), "o_orderkey")


@register("SELECT count(*) AS n FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND month(o_orderdate) IN (5, 6)")
def catalog_count(spark, sf_dir):
    filters = catalog.Filters(least={"o_totalprice": 100000}, most={"o_totalprice": 200000}, months={"o_orderdate": [5, 6]})
    return read(spark, sf_dir, "orders").filter(filters.condition()).agg(F.count("*").alias("n"))


@register("""
SELECT p_partkey, p_name, p_retailprice, CAST(row_number() OVER (ORDER BY p_retailprice DESC, lower(p_name), p_partkey) AS INTEGER) AS ordinal
FROM part WHERE p_size >= 10 ORDER BY p_retailprice DESC, lower(p_name), p_partkey LIMIT 10""")
def catalog_rank_top_n(spark, sf_dir):
    rows = read(spark, sf_dir, "part").filter(catalog.Filters(least={"p_size": 10}).condition())
    return catalog.ranked(rows.select("p_partkey", "p_name", "p_retailprice"), "p_retailprice", "p_name", "p_partkey")


@register("""
SELECT p_partkey, p_name, p_size, CAST(row_number() OVER (ORDER BY p_size, lower(p_name), p_partkey) AS INTEGER) AS ordinal
FROM part WHERE p_brand = 'Brand#3' ORDER BY p_size, lower(p_name), p_partkey LIMIT 20""")
def catalog_rank_asc(spark, sf_dir):
    rows = read(spark, sf_dir, "part").filter(catalog.Filters(equal={"p_brand": "Brand#3"}).condition())
    return catalog.ranked(rows.select("p_partkey", "p_name", "p_size"), "p_size", "p_name", "p_partkey", descending=False, limit=20)


@register("""
SELECT p_partkey, p_name, p_retailprice, votes, CAST(row_number() OVER (ORDER BY p_retailprice DESC, lower(p_name), p_partkey) AS INTEGER) AS ordinal
FROM (SELECT *, p_size * 40 AS votes FROM part) WHERE votes >= 1000 ORDER BY p_retailprice DESC, lower(p_name), p_partkey LIMIT 10""")
def rank_with_vote_floor(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", (F.col("p_size") * 40).alias("votes"))
    return catalog.rated(rows, "p_retailprice", "votes", "p_name", "p_partkey")


@register("""
SELECT 'No movies featuring Ann De Lee were found in this dataset.' AS answer UNION ALL
SELECT 'No movies matched all requested filters for Ann De Lee in this ' || CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN min(year(o_orderdate)) || ' ' ELSE '' END || 'dataset.'
FROM orders WHERE year(o_orderdate) = 1996 UNION ALL SELECT 'No movies matched those structured filters.'""")
def no_matches_answers(spark, sf_dir):
    """What is said where nothing matches, over all orders and those of one year."""
    rows = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    one = catalog.no_matches_text(rows.filter("year = 1996"), "year", "ANN  de lee", narrowed=True)
    return catalog.no_matches_text(rows, "year", " ann de Lee").unionByName(one).unionByName(catalog.no_matches_text(rows, "year"))


@register("""
SELECT 'year' AS kind, CAST(year(o_orderdate) AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'priority', coalesce(o_orderpriority, 'Uncategorized'), count(*) FROM orders GROUP BY 2""")
def catalog_summary_groups(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority")
    years = catalog.group_counts(rows, F.year("o_orderdate"), "year", "Unknown")
    return years.unionByName(catalog.group_counts(rows, F.col("o_orderpriority"), "priority", "Uncategorized"))


@register("""
SELECT string_agg(value || ': ' || n, '; ' ORDER BY n DESC, value) AS answer
FROM (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 8)""")
def catalog_top_groups_text(spark, sf_dir):
    return catalog.top_groups_text(catalog.group_counts(read(spark, sf_dir, "part"), F.col("p_type"), "type", "Uncategorized"))


@register("SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS release_month FROM orders WHERE month(o_orderdate) = 5")
def release_month_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").filter(catalog.Filters(months={"o_orderdate": [5]}).condition())
    return rows.select("o_orderkey", F.month("o_orderdate").alias("release_month"))


@register("SELECT month(o_orderdate)::INTEGER AS release_month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE month(o_orderdate) IN (3, 7, 11) GROUP BY 1")
def release_month_set(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").filter(catalog.Filters(months={"o_orderdate": [3, 7, 11]}).condition())
    return rows.groupBy(F.month("o_orderdate").alias("release_month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("""
SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' THEN 'kept' ELSE 'outside_release_window' END AS reason
FROM orders""")
def window_between(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", catalog.window_status(day, "1996-01-01", "1997-12-31").alias("reason"))


@register(r"""
SELECT p_partkey, p_name FROM part
WHERE list_contains(string_split(lower(trim(regexp_replace(regexp_replace(p_name, '[-_/]+', ' ', 'g'), '\s+', ' ', 'g'))), ' '), 'blue')
  AND list_contains(string_split(lower(trim(regexp_replace(regexp_replace(p_name, '[-_/]+', ' ', 'g'), '\s+', ' ', 'g'))), ' '), 'ring')""")
def person_token_match(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return rows.filter(catalog.name_has_tokens(F.array("p_name"), ["blue", "ring"]))


@register("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name || ' ' || p_type), 'widget') AND contains(lower(p_name || ' ' || p_type), 'eco')")
def topic_terms_contains(spark, sf_dir):
    filters = catalog.Filters(terms=("widget", "eco"), term_columns=("p_name", "p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type").filter(filters.condition())


@register("""
SELECT count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice < 10000) AS small,
  count(*) FILTER (WHERE o_orderdate IS NULL) AS undated, count(DISTINCT o_custkey) AS customers FROM orders""")
def quality_counters(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(
        F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") < 10000).alias("small"),
        F.count_if(F.col("o_orderdate").isNull()).alias("undated"), F.count_distinct("o_custkey").alias("customers"),
    )


# joins and de-duplication


@register("""
SELECT c_custkey, n_orders, spent FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) ON c_custkey = o_custkey""")
def left_join_ratings(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").filter(F.year("o_orderdate") == 1996)
    sums = orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    customers = read(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_orders", "spent")


@register("""
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS cast_list FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position
  FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
WHERE position <= 3 GROUP BY 1""")
def semi_join_topk_cast(spark, sf_dir):
    kept = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").join(kept, "l_orderkey", "left_semi")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    top = relational.top_per_key(lines, ["l_orderkey"], order, 3)
    values = relational.ordered_values(top, ["l_orderkey"], F.col("l_partkey").cast("string"), F.col("position"))
    return values.select("l_orderkey", F.array_join("values", ",").alias("cast_list"))


@register("""
SELECT s_nationkey, arg_min(s_name, {'s': -score, 'o': s_suppkey}) AS title, max(score) AS score
FROM (SELECT *, CASE WHEN s_acctbal > 8000 THEN 2 WHEN s_acctbal > 4000 THEN 1 ELSE 0 END AS score FROM supplier) GROUP BY 1""")
def argmax_regional_title(spark, sf_dir):
    score = F.when(F.col("s_acctbal") > 8000, 2).when(F.col("s_acctbal") > 4000, 1).otherwise(0)
    best = relational.best_by_score(read(spark, sf_dir, "supplier"), "s_nationkey", score, F.col("s_suppkey"), F.col("s_name"))
    return best.select("s_nationkey", F.col("value").alias("title"), "score")


@register("""
SELECT l_orderkey, string_agg(coalesce(s_name, CAST(l_suppkey AS VARCHAR)), ', ' ORDER BY l_linenumber, l_suppkey, l_partkey) AS names
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey GROUP BY 1""")
def ordered_name_lookup(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    lists = relational.ordered_values(lines, ["l_orderkey"], F.col("l_suppkey"), F.struct("l_linenumber", "l_suppkey", "l_partkey"))
    names = read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    found = relational.names_in_order(lists, "l_orderkey", "values", names)
    return found.select("l_orderkey", F.array_join("values", ", ").alias("names"))


@register("""
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'no_match' WHEN c_mktsegment = 'MACHINERY' THEN 'join_mismatch' ELSE 'matched' END AS status,
  coalesce(nullif(c_name, ''), 'order ' || o_orderkey) AS title
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def merge_status_routing(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    joined = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    status = F.when(F.col("c_custkey").isNull(), "no_match").when(F.col("c_mktsegment") == "MACHINERY", "join_mismatch").otherwise("matched")
    title = relational.known_text(F.col("c_name"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    return joined.select("o_orderkey", status.alias("status"), title.alias("title"))


@register("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1997)")
def stale_anti_join(spark, sf_dir):
    current = read(spark, sf_dir, "lineitem").filter(F.year("l_shipdate") == 1997).select(F.col("l_partkey").alias("p_partkey"))
    return index.stale(read(spark, sf_dir, "part").select("p_partkey"), current, "p_partkey")


@register("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1997)")
def existing_semi_join(spark, sf_dir):
    current = read(spark, sf_dir, "lineitem").filter(F.year("l_shipdate") == 1997).select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", "p_name").join(current, "p_partkey", "left_semi")


@register("""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def dedup_last_wins(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return relational.last_wins(events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@register("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_first_wins(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return relational.first_wins(docs, ["content_hash"], [F.col("doc_id")])


@register("""
SELECT id, name, balance, run FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY run DESC) AS n FROM (
  SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'customers' AS run FROM customer
  UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'suppliers' FROM supplier)) WHERE n = 1""")
def run_merge(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customers").alias("run"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("suppliers").alias("run"))
    return relational.run_merge([customers, suppliers], "id")


@register("""
SELECT p_type, array_to_string(list_slice(list_sort(list_distinct([x FOR x IN list(p_brand) IF x <> 'Brand#1' AND x <> 'Brand#2'])), 1, 20), ',') AS akas
FROM part GROUP BY 1""")
def akas_except(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_type", "p_brand", F.lit("Brand#1").alias("title"), F.lit("Brand#2").alias("original"))
    other = relational.other_titles(rows, "p_type", "p_brand", ["title", "original"], 20)
    return other.select("p_type", F.array_join("titles", ",").alias("akas"))


@register("""
SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def golden_duplicates(spark, sf_dir):
    return evaluation.duplicate_keys(read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), ["o_custkey", "day"])


@register("""
SELECT lang, coalesce(n, 0) AS n, CAST(least_n AS BIGINT) AS least, coalesce(n, 0) >= least_n AS met FROM (VALUES ('en', 500), ('de', 200), ('fr', 100), ('it', 1)) AS w(lang, least_n)
LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) USING (lang)""")
def category_minima(spark, sf_dir):
    return evaluation.minima_report(read(spark, sf_dir, "documents"), "lang", {"en": 500, "de": 200, "fr": 100, "it": 1})


# chunks and indexes


@register("""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_number, substring(text, i * 1200 + 1, 1200) AS text
FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 1200.0) AS BIGINT), 1))) AS i FROM documents)
WHERE trim(substring(text, i * 1200 + 1, 1200)) <> ''""")
def naive_windows(spark, sf_dir):
    return chunking.fixed_windows(read(spark, sf_dir, "documents"))


@register()
def paragraph_chunks(spark, sf_dir):
    return chunking.paragraph_chunks(read(spark, sf_dir, "documents"))


@register("""
SELECT count(*) AS n, min(length(c)) AS least, median(length(c)) AS middle, max(length(c)) AS most FROM (
  SELECT substring(text, i * 1200 + 1, 1200) AS c
  FROM (SELECT text, unnest(range(0, greatest(CAST(ceil(length(text) / 1200.0) AS BIGINT), 1))) AS i FROM documents)) WHERE trim(c) <> ''""")
def chunk_distribution(spark, sf_dir):
    return chunking.length_spread(chunking.fixed_windows(read(spark, sf_dir, "documents")))


@register("""
SELECT count(*) AS n_texts, count(*) FILTER (WHERE ceil(length(text) / 4.0) > 512) AS truncated FROM documents""")
def truncation_counter(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("n_texts"), F.count_if(T.chunk_tokens(F.col("text")) > 512).alias("truncated"))


_POSTINGS = """
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2),
l AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS length FROM documents),
s AS (SELECT count(*) AS n, avg(length) AS avg_len FROM l)"""


@register(f"WITH {_POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, n AS n_texts, round(avg_len, 6) AS avg_len FROM p, s GROUP BY term, n, avg_len")
def bm25_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    stats = F.broadcast(index.corpus_stats(index.text_lengths(docs, "doc_id")))
    terms = index.postings(docs, "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return terms.join(stats).select("term", "df", "tf", F.col("n").alias("n_texts"), F.round("avg_len", 6).alias("avg_len"))


_BM25 = f"""
WITH {_POSTINGS},
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
scored AS (
  SELECT query_id, p.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_len)))) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN l ON l.doc_id = p.doc_id, s GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 20)"""


def _sparse(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    terms = materialize(index.postings(read(spark, sf_dir, "benchmark"), "item_id").select(F.col("item_id").alias("query_id"), "term"), "query-terms")
    posted = materialize(index.postings(docs, "doc_id", only=terms), "postings")
    scores = index.bm25_scores(posted, index.text_lengths(docs, "doc_id"), terms, "doc_id")
    return retrieval.ranked_lists(scores.withColumn("score", F.round("score", 9)), "doc_id", 20)


@register(f"{_BM25} SELECT query_id, doc_id, round(score, 3) AS score, rank FROM sparse")
def bm25_topk(spark, sf_dir):
    return _sparse(spark, sf_dir).select("query_id", "doc_id", F.round("score", 3).alias("score"), "rank")


@register()
def bm25_stemmed_topk(spark, sf_dir):
    """The twenty best documents for each benchmark text by stems: accents aside, English words by Porter's rules."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    stems = index.stemmed_postings(read(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")
    asked = materialize(stems.select(F.col("item_id").alias("query_id"), "term"), "query-terms")
    words = materialize(index.word_stems(docs, asked), "word-stems")
    found = retrieval.sparse_topk(docs, asked, 20, "doc_id", token=index.WORD, words=words)
    return found.select("query_id", "doc_id", F.round("score", 3).alias("score"), "rank")


_DENSE = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, vec_id, label, round(greatest(0, least(1, list_cosine_similarity(qe, e))), 9) AS score FROM q, v {where}),
dense AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored) WHERE rank <= {k})"""


def _dense(spark, sf_dir, k: int, condition=None) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_topk(vectors, queries, k, condition=condition)


@register(_DENSE.format(where="", k=20) + " SELECT query_id, vec_id, round(score, 6) AS score, rank FROM dense")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 20).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@register(_DENSE.format(where="WHERE label IN (1, 3, 5)", k=10) + " SELECT query_id, vec_id, round(score, 6) AS score, rank FROM dense")
def dense_topk_filtered(spark, sf_dir):
    found = _dense(spark, sf_dir, 10, F.col("label").isin(1, 3, 5))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_OTHER = """other AS (
  SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), vec_id) AS INTEGER) AS rank
  FROM (SELECT DISTINCT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0) JOIN (SELECT vec_id FROM embeddings) ON abs(vec_id - query_id) BETWEEN 1 AND 10)"""


def _by_number(spark, sf_dir) -> DataFrame:
    """A second list for each query: the vectors of the nearest numbers."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id")
    steps = F.explode(F.filter(F.sequence(F.lit(-10), F.lit(10)), lambda i: i != 0)).alias("step")
    wanted = vectors.filter("vec_id % 100 = 0").distinct().select(F.col("vec_id").alias("query_id"), steps)
    near = F.row_number().over(Window.partitionBy("query_id").orderBy(F.abs(F.col("vec_id") - F.col("query_id")), "vec_id"))
    return wanted.withColumn("vec_id", F.col("query_id") + F.col("step")).join(vectors, "vec_id").select("query_id", "vec_id", near.alias("rank"))


@register(_DENSE.format(where="", k=20) + """,
""" + _OTHER + """,
fused AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT query_id, vec_id, rank FROM dense UNION ALL SELECT * FROM other) GROUP BY 1, 2)
SELECT query_id, vec_id, round(rrf, 8) AS rrf FROM fused""")
def rrf_hybrid(spark, sf_dir):
    """Two lists of their own for each query, by cosine and by nearness of number; most vectors stand in one of them only."""
    dense = _dense(spark, sf_dir, 20).select("query_id", "vec_id", "rank")
    fused = retrieval.reciprocal_rank_fusion([dense, _by_number(spark, sf_dir)], "vec_id")
    return fused.select("query_id", "vec_id", F.round("rrf", 8).alias("rrf"))


@register(_DENSE.format(where="", k=20) + """,
""" + _OTHER + """,
a AS (SELECT query_id, vec_id, rank AS dense_rank, round(score, 6) AS dense_score, CASE WHEN rank % 2 = 0 THEN label END AS label, 'dense' AS source FROM dense),
b AS (SELECT query_id, o.vec_id, o.rank AS sparse_rank, abs(o.vec_id - query_id) AS distance, label, CASE WHEN o.rank % 3 = 0 THEN 'sparse' END AS source FROM other o JOIN embeddings e ON e.vec_id = o.vec_id)
SELECT query_id, vec_id, dense_rank, dense_score, coalesce(b.label, a.label) AS label, coalesce(b.source, a.source) AS source, sparse_rank, distance,
  round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0), 8) AS rrf
FROM a FULL JOIN b USING (query_id, vec_id)""")
def overlay_fusion(spark, sf_dir):
    """Two lists merged field by field; each has columns of its own, and shared ones that are null in places."""
    labels = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    dense = _dense(spark, sf_dir, 20).join(labels, "vec_id").select(
        "query_id", "vec_id", F.col("rank").alias("dense_rank"), F.round("score", 6).alias("dense_score"), F.when(F.col("rank") % 2 == 0, F.col("label")).alias("label"), F.lit("dense").alias("source")
    )
    other = _by_number(spark, sf_dir).join(labels, "vec_id")
    other = other.select("query_id", "vec_id", F.col("rank").alias("sparse_rank"), F.abs(F.col("vec_id") - F.col("query_id")).alias("distance"), "label", F.when(F.col("rank") % 3 == 0, "sparse").alias("source"))
    return retrieval.overlaid([dense, other], ["query_id", "vec_id"], ["dense_rank", "sparse_rank"]).withColumn("rrf", F.round("rrf", 8))


@register(_DENSE.format(where="", k=20) + """
SELECT query_id, vec_id, label, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM dense) WHERE n <= 2""")
def diversity_cap(spark, sf_dir):
    found = _dense(spark, sf_dir, 20).join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    few = retrieval.diverse(found, "label", "vec_id", [F.col("rank")], 2, ["query_id"])
    return few.select("query_id", "vec_id", "label", "rank")


@register(_DENSE.format(where="", k=20) + """,
attempts AS (SELECT query_id AS attempt, vec_id, rank, score FROM dense)
SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS fused, arg_max(attempt, {'s': score, 'a': -attempt}) AS attempt, round(max(score), 6) AS score FROM attempts GROUP BY 1""")
def fusion_multi_attempt(spark, sf_dir):
    found = _dense(spark, sf_dir, 20).withColumn("score", F.round("score", 9))
    attempts = found.select(F.col("query_id").alias("attempt"), "vec_id", "rank", "score", F.lit(None).cast("double").alias("rerank_score"))
    return retrieval.fuse_attempts(attempts, "vec_id").select("vec_id", "fused", "attempt", F.round("score", 6).alias("score"))


@register()
def hybrid_search(spark, sf_dir):
    """Windows of all documents against the benchmark texts, sparse and dense lists fused, reranked and capped."""
    chunks = chunking.fixed_windows(read(spark, sf_dir, "documents")).withColumn("chunk_id", F.col("doc_id") * 100_000 + F.col("chunk_number"))
    chunks = chunks.select("chunk_id", "doc_id", "text")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    terms = materialize(index.postings(asked, "query_id").select("query_id", "term"), "query-terms")
    sparse = retrieval.sparse_topk(chunks, terms, 20, "chunk_id")
    queries = index.embed(asked, "query_id", "text").withColumnRenamed("vector", "embedding")
    dense = retrieval.dense_topk(index.embed(chunks, "chunk_id", "text").withColumnRenamed("vector", "embedding"), queries, 20, key="chunk_id")
    return retrieval.hybrid(dense, sparse, chunks, asked, "chunk_id", "doc_id")


@register("""
SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'wrong_dimension' WHEN n = 0 THEN 'zero_vector' WHEN abs(n - 1) > 1e-3 THEN 'not_normalised' END AS error, round(n, 6) AS length
FROM (SELECT *, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)""")
def vector_validation(spark, sf_dir):
    checked = index.vector_errors(read(spark, sf_dir, "embeddings"), "embedding", 64)
    return checked.select("vec_id", "error", F.round(T.norm(F.col("embedding")), 6).alias("length"))


@register("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'miss' ELSE 'hit' END AS status, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def cache_hit_miss(spark, sf_dir):
    cache = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return index.cache_status(read(spark, sf_dir, "documents").select("doc_id"), cache, ["doc_id"]).select("doc_id", "status", "quality")


# lookup


@register("""
WITH names AS (SELECT lower(p_name) AS t, min(p_partkey) AS p_partkey, count(*) AS n FROM part GROUP BY 1)
SELECT c_custkey AS query_id, p_partkey, n AS parts FROM customer JOIN names ON t = split_part('blue,red,small,large,green', ',', CAST(c_custkey % 5 AS INTEGER) + 1) || ' ' || split_part('ring,bolt,widget,gear,rod,plate,anvil', ',', CAST(c_custkey % 7 AS INTEGER) + 1)""")
def title_exact_lookup(spark, sf_dir):
    """A title asked by each customer, written with dashes and capitals, against the distinct part names."""
    names = read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("parts"))
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (F.col("c_custkey") % n).cast("int") + 1)
    asked = F.upper(F.concat(pick(["blue", "red", "small", "large", "green"], 5), F.lit("-"), pick(["ring", "bolt", "widget", "gear", "rod", "plate", "anvil"], 7)))
    queries = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), asked.alias("query"))
    return lookup.exact_titles(queries, names, "p_name").select("query_id", "p_partkey", "parts")


@register("SELECT s_suppkey AS alias, n_nationkey FROM supplier JOIN nation ON lower(n_name) = 'nation_' || s_nationkey")
def alias_lookup(spark, sf_dir):
    aliases = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("alias"), F.concat(F.lit(" Nation/"), F.col("s_nationkey").cast("string")).alias("target"))
    return lookup.alias_targets(aliases, read(spark, sf_dir, "nation"), "n_name").select("alias", "n_nationkey")


@register()
def title_fuzzy_lookup(spark, sf_dir):
    """Part names with a letter dropped, against the distinct part names."""
    names = read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    queries = names.select(F.col("p_partkey").alias("query_id"), F.expr("concat(substring(p_name, 1, 2), substring(p_name, 4))").alias("query"))
    return lookup.fuzzy_titles(queries, names, "p_partkey", "p_name")


def _films(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Part names as records of films with their year, votes and other names, and aliases of every fifth one."""
    names = read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"), F.max("p_size").alias("votes"))
    akas = F.array(F.concat(F.reverse("p_name"), F.lit(": Film")), F.concat_ws(" ", F.reverse(F.split("p_name", " "))), F.lit(" "))
    records = names.select("p_partkey", "p_name", (1950 + F.col("p_partkey") % 40).alias("year"), "votes", F.upper("p_name").alias("original"), akas.alias("akas"))
    aliases = names.filter("p_partkey % 5 = 0").select(F.concat(F.lit("project "), F.md5("p_name")).alias("alias"), F.col("p_name").alias("target"))
    return records, aliases


@register()
def title_resolution(spark, sf_dir):
    """Records named with a slip and a year, by another name, by a configured alias, or by no name at all."""
    records, aliases = _films(spark, sf_dir)
    slip = F.expr("concat('\"', substring(p_name, 1, 2), substring(p_name, 4), '\" (', year, ') movie')")
    kind = F.col("p_partkey") % 5
    asked = F.when(kind == 0, F.concat(F.lit("Project "), F.md5("p_name"))).when(kind == 1, F.concat(F.reverse("p_name"), F.lit(" film?"))).when(kind == 2, "the movie")
    queries = records.select(F.col("p_partkey").alias("query_id"), asked.otherwise(slip).alias("query"))
    forms = lookup.title_forms(records, "p_partkey", "p_name", "original", "akas", aliases)
    return lookup.resolve_titles(queries, records, forms, "p_partkey", "p_name", "year", "votes")


@register("""
WITH r AS (SELECT p_partkey, p_name AS canonical, lower(substring(p_name, 1, 5)) AS candidate, 'Who made ' || upper(p_name) || ' and ' || p_name || '?' AS query FROM part),
a AS (SELECT *, position(candidate IN lower(query)) AS n FROM r)
SELECT p_partkey, substring(query, 1, n - 1) || canonical || substring(query, n + length(candidate)) AS rewritten FROM a""")
def title_rewrite(spark, sf_dir):
    """Questions with the first mention of a part's name replaced by the name in full."""
    query = F.concat(F.lit("Who made "), F.upper("p_name"), F.lit(" and "), "p_name", F.lit("?"))
    rewritten = lookup.rewritten_with_title(query, F.lower(F.substring("p_name", 1, 5)), F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", rewritten.alias("rewritten"))


@register("""
WITH n AS (SELECT DISTINCT p_type AS title FROM part UNION SELECT DISTINCT n_name FROM nation),
q AS (SELECT s_suppkey AS query_id, 'suppliers of NATION_' || s_nationkey || ' selling ' || CASE s_suppkey % 3 WHEN 0 THEN 'promo' WHEN 1 THEN 'medium' ELSE 'any' END || ' parts' AS query FROM supplier)
SELECT query_id, arg_max(title, {'n': length(title), 't': title}) AS title FROM q LEFT JOIN n ON contains(replace(lower(query), '_', ' '), replace(lower(title), '_', ' ')) GROUP BY 1""")
def seed_longest_containment(spark, sf_dir):
    titles = read(spark, sf_dir, "part").select(F.col("p_type").alias("title")).union(read(spark, sf_dir, "nation").select("n_name"))
    kind = F.element_at(F.array(F.lit("promo"), F.lit("medium"), F.lit("any")), (F.col("s_suppkey") % 3).cast("int") + 1)
    query = F.concat(F.lit("suppliers of NATION_"), F.col("s_nationkey").cast("string"), F.lit(" selling "), kind, F.lit(" parts"))
    questions = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), query.alias("query"))
    return lookup.longest_contained(questions, titles, "title")


# conversations and logs


@register("""
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')) WHERE back <= 3""")
def history_window(spark, sf_dir):
    return conversation.last_turns(read(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role", "position")


@register(r"""
SELECT conv_id, turn, answer_turn FROM (
  SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answer_turn FROM conversations)
WHERE role = 'user' AND regexp_matches(lower(text), '\b(it|(this|that|the)\s+(movie|film))\b')""")
def conversation_reference(spark, sf_dir):
    return conversation.with_reference(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "answer_turn")


@register("""
SELECT event_id, decision, CASE WHEN decision = 'error' THEN 'system_error' WHEN decision = 'refused' THEN 'needs_review'
  WHEN event_type = 'signup' OR value >= 40 THEN 'recall_miss_recovered' ELSE 'answered' END AS triage_bucket
FROM (SELECT *, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'refused' ELSE 'answered' END AS decision FROM events)""")
def query_log_triage(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    kind = F.when(F.col("event_type") == "view", "refusal").otherwise("answer")
    stage, selected = F.when(F.col("event_type") == "signup", "escalation"), F.when(F.col("value") >= 40, "multi_query_hyde_rrf")
    log = read(spark, sf_dir, "events").withColumn("decision", conversation.log_decision(status, kind))
    return log.select("event_id", "decision", conversation.triage(F.col("decision"), stage, selected).alias("triage_bucket"))


@register(r"""
WITH t AS (
  SELECT *, CASE WHEN role = 'assistant' AND regexp_extract(text, '[a-z]{6,}', 0) <> '' THEN regexp_extract(text, '[a-z]{6,}', 0) END AS own FROM conversations),
w AS (
  SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS title FROM t),
r AS (
  SELECT conv_id, turn, title, CASE WHEN regexp_matches(lower(text), '\b(it|(this|that|the)\s+(movie|film))\b')
    THEN regexp_replace(trim(text), '\b(it|(this|that|the)\s+(movie|film))\b', title, 'gi') END AS rewritten FROM w WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN rewritten IS NOT NULL THEN title END AS referenced_title, rewritten FROM r""")
def reference_rewrite(spark, sf_dir):
    """User turns with words that refer back replaced by the one source of the answer before, here its first long word."""
    word = F.regexp_extract("text", "[a-z]{6,}", 0)
    turns = read(spark, sf_dir, "conversations").withColumn("titles", F.array(word))
    return conversation.resolved_references(turns).select("conv_id", "turn", "referenced_title", "rewritten")


@register("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def query_log_recent(spark, sf_dir):
    log = read(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", "ts")
    return conversation.recent(log, [F.desc("ts"), F.desc("event_id")], 100, F.col("event_type") == "error").select("event_id", "user_id", "value")


@register("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def query_log_stream(spark, sf_dir):
    """Daily counts by a stream over the log, run until it has read what is there."""
    return querylog.daily_counts(spark, sf_dir)


@register("""
SELECT user_id, event_type, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) = 1""")
def stream_upsert(spark, sf_dir):
    """The last event of each user and kind, merged batch by batch from the log's stream."""
    return querylog.last_events(spark, sf_dir)


@register(r"""
SELECT event_id, array_to_string([CAST(x AS VARCHAR) FOR x IN list_sort(list_distinct(regexp_extract_all('see [' || user_id || '] and [' || CAST(event_id % 7 AS VARCHAR) || ']', '\[(\d+)\]', 1)))], ',') AS numbers
FROM events""")
def citation_numbers(spark, sf_dir):
    text = F.concat(F.lit("see ["), F.col("user_id").cast("string"), F.lit("] and ["), (F.col("event_id") % 7).cast("string"), F.lit("]"))
    numbers = F.array_sort(F.transform(T.citation_numbers(text), lambda x: x.cast("string")))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(numbers, ",").alias("numbers"))


@register("SELECT p_partkey, 'Brand Name: ' || p_brand || ' | Part Type: ' || p_type || ' | Size: ' || p_size AS facts FROM part")
def quick_facts_text(spark, sf_dir):
    facts = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("part_type"), F.col("p_type"), F.lit("brand_name"), F.col("p_brand"), F.lit("empty"), F.lit(""))
    return read(spark, sf_dir, "part").select("p_partkey", T.facts_text(facts).alias("facts"))


# evaluation

_RUNS = _DENSE.format(where="", k=20) + """,
gold AS (SELECT query_id, list(v2.vec_id ORDER BY v2.vec_id) AS gold FROM q JOIN v v1 ON v1.vec_id = query_id JOIN v v2 ON v2.label = v1.label AND v2.vec_id <> query_id AND abs(v2.vec_id - query_id) <= 50 GROUP BY 1),
hits AS (SELECT d.query_id, rank, list_contains(gold, vec_id) AS hit, len(gold) AS n FROM dense d JOIN gold USING (query_id)),
items AS (
  SELECT query_id, CASE WHEN query_id % 200 = 0 THEN 'dev' ELSE 'test' END AS split,
    count(*) FILTER (WHERE hit AND rank <= 5) / n AS recall_5, count(*) FILTER (WHERE hit AND rank <= 20) / n AS recall_20,
    coalesce(1.0::DOUBLE / min(CASE WHEN hit THEN rank END), 0) AS rr,
    coalesce(sum(CASE WHEN hit AND rank <= 10 THEN 1 / log2(rank + 1) END), 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, 10) + 1)]) AS ndcg_10
  FROM hits GROUP BY query_id, n)"""


def _items(spark, sf_dir) -> DataFrame:
    """Each query's neighbours against the vectors of its label that have a near number."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    near = F.broadcast(queries.withColumnRenamed("label", "_l"))
    gold = vectors.join(near, (F.col("label") == F.col("_l")) & (F.col("vec_id").between(F.col("query_id") - 50, F.col("query_id") + 50)))
    gold = gold.filter("vec_id <> query_id")
    gold = gold.groupBy("query_id").agg(F.collect_list("vec_id").alias("gold"))
    found = relational.ordered_values(_dense(spark, sf_dir, 20), ["query_id"], F.col("vec_id"), F.col("rank"))
    runs = found.withColumnRenamed("values", "found").join(gold, "query_id")
    return evaluation.item_metrics(runs).withColumn("split", F.when(F.col("query_id") % 200 == 0, "dev").otherwise("test"))


_METRICS = ["recall_5", "recall_20", "rr", "ndcg_10"]
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)


@register(f"{_RUNS} SELECT query_id, split, {_ROUNDED} FROM items")
def item_metrics(spark, sf_dir):
    return _items(spark, sf_dir).select("query_id", "split", *(F.round(m, 6).alias(m) for m in _METRICS))


@register(f"{_RUNS} SELECT 'dense' AS baseline, coalesce(split, 'all') AS split, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)} FROM items GROUP BY GROUPING SETS ((), (split))")
def metrics_by_split(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("baseline", F.lit("dense"))
    grouped = evaluation.grouped_metrics(items, "baseline", "split", _METRICS)
    return grouped.select("baseline", "split", "n", *(F.round(m, 6).alias(m) for m in _METRICS))


@register(f"""{_RUNS} SELECT failure, count(*) AS n FROM (
  SELECT CASE WHEN recall_20 = 0 THEN 'retrieval_miss' WHEN rr < 1 THEN 'rank_failure' END AS failure FROM items) WHERE failure IS NOT NULL GROUP BY 1""")
def failure_labels(spark, sf_dir):
    label = evaluation.failure_label(F.lit(True), F.lit(False), F.col("recall_20"), 1 / F.nullif(F.col("rr"), F.lit(0.0)))
    return _items(spark, sf_dir).select(label.alias("failure")).filter("failure IS NOT NULL").groupBy("failure").agg(F.count("*").alias("n"))


_BASELINES = ["B0_refusal", "B1_sparse", "B2_dense", "B3_fused"]
_GATES = {"B2_dense": 0.4, "B3_fused": 0.02}
_BASELINE_METRICS = [*_METRICS, "answer_support_5", "citation_valid_5", "correct_refusal", "over_refusal"]
_BASELINE_SQL = _RUNS + """,
""" + _OTHER + f""",
alone AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM dense WHERE vec_id <> query_id),
both_lists AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, vec_id, rank FROM alone UNION ALL SELECT * FROM other) GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM both_lists) WHERE rank <= 20),
runs AS (
  SELECT 'B1_sparse' AS baseline, query_id, vec_id, rank, NULL::DOUBLE AS score FROM other WHERE query_id % 500 <> 0
  UNION ALL SELECT 'B2_dense', query_id, vec_id, rank, score FROM alone UNION ALL SELECT 'B3_fused', query_id, vec_id, rank, score FROM fused),
asked AS (SELECT query_id, query_id % 300 <> 0 AS answerable, CASE WHEN query_id % 300 <> 0 THEN coalesce(gold, []) ELSE [] END AS gold, baseline
  FROM q LEFT JOIN gold USING (query_id), (SELECT unnest({_BASELINES!r}) AS baseline)),
found AS (
  SELECT a.query_id, a.baseline, any_value(answerable) AS answerable, any_value(a.gold) AS gold, coalesce(list(vec_id ORDER BY rank) FILTER (vec_id IS NOT NULL), []) AS found, arg_min(score, rank) AS top
  FROM asked a LEFT JOIN runs r ON r.query_id = a.query_id AND r.baseline = a.baseline GROUP BY 1, 2),
stated AS (
  SELECT *, CASE WHEN baseline = 'B0_refusal' THEN 'refused' WHEN len(found) = 0 THEN 'no_results'
    WHEN (baseline = 'B2_dense' AND top < 0.4) OR (baseline = 'B3_fused' AND top < 0.02) THEN 'low_confidence' ELSE 'ok' END AS status,
    [i FOR i IN range(1, len(found) + 1) IF list_contains(gold, found[i])] AS places, len(gold) AS n FROM found),
measured AS (
  SELECT query_id, baseline, answerable, status, CASE WHEN n > 0 THEN len([i FOR i IN places IF i <= 5]) / n END AS recall_5, CASE WHEN n > 0 THEN len([i FOR i IN places IF i <= 20]) / n END AS recall_20,
    CASE WHEN n > 0 THEN coalesce(1.0::DOUBLE / list_min(places), 0) END AS rr,
    CASE WHEN n > 0 THEN coalesce(list_sum([1 / log2(i + 1) FOR i IN places IF i <= 10]), 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, 10) + 1)]) END AS ndcg_10,
    CASE WHEN n > 0 THEN CAST(len([i FOR i IN places IF i <= 5]) = n AS DOUBLE) END AS answer_support_5, CASE WHEN n > 0 THEN CAST(len([i FOR i IN places IF i <= 5]) > 0 AS DOUBLE) END AS citation_valid_5,
    CASE WHEN NOT answerable THEN CAST(status <> 'ok' AS DOUBLE) END AS correct_refusal, CASE WHEN answerable THEN CAST(status <> 'ok' AS DOUBLE) END AS over_refusal FROM stated)"""


def _measured(spark, sf_dir) -> DataFrame:
    """Four baselines over the same candidates: none, by number, by cosine, and both fused; some items have no answer."""
    dense = _dense(spark, sf_dir, 20).filter("vec_id <> query_id").select("query_id", "vec_id", "score")
    dense = materialize(retrieval.ranked_lists(dense.withColumn("score", F.round("score", 9)), "vec_id", 20), "dense-candidates")
    other = materialize(_by_number(spark, sf_dir), "sparse-candidates")
    fused = retrieval.reciprocal_rank_fusion([dense, other], "vec_id").select("query_id", "vec_id", F.col("rrf").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    fused = fused.withColumn("rank", F.row_number().over(order)).filter("rank <= 20")
    sparse = other.filter("query_id % 500 <> 0").withColumn("score", F.lit(None).cast("double"))
    return evaluation.baselines(_gold(spark, sf_dir), {"B0_refusal": None, "B1_sparse": sparse, "B2_dense": dense, "B3_fused": fused}, _GATES, "vec_id")


def _gold(spark, sf_dir) -> DataFrame:
    """Each query with the vectors of its label that have a near number as gold, and whether it has an answer."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    steps = F.explode(F.filter(F.sequence(F.lit(-50), F.lit(50)), lambda i: i != 0)).alias("step")
    near = queries.select("query_id", F.col("label").alias("own"), steps).withColumn("vec_id", F.col("query_id") + F.col("step")).join(vectors, "vec_id").filter("label = own")
    answerable = F.col("query_id") % 300 != 0
    gold = near.groupBy("query_id").agg(F.collect_list("vec_id").alias("gold"))
    none = F.array().cast("array<long>")
    return queries.join(gold, "query_id", "left").select("query_id", answerable.alias("answerable"), F.when(answerable, F.coalesce("gold", none)).otherwise(none).alias("gold"))


@register(f"{_BASELINE_SQL} SELECT query_id, baseline, status, {', '.join(f'round({m}, 6) AS {m}' for m in _BASELINE_METRICS)} FROM measured")
def baseline_items(spark, sf_dir):
    """One row per item and baseline: what was refused and why, and the metrics of its list."""
    return _measured(spark, sf_dir).select("query_id", "baseline", "status", *(F.round(m, 6).alias(m) for m in _BASELINE_METRICS))


@register(f"""{_BASELINE_SQL} SELECT baseline, coalesce(split, 'all') AS split, count(*) AS n, {', '.join(f'round(coalesce(avg({m}), 0), 6) AS {m}' for m in _BASELINE_METRICS)}
FROM (SELECT *, CASE WHEN query_id % 200 = 0 THEN 'dev' ELSE 'test' END AS split FROM measured) GROUP BY GROUPING SETS ((baseline), (baseline, split))""")
def baseline_summary(spark, sf_dir):
    items = _measured(spark, sf_dir).withColumn("split", F.when(F.col("query_id") % 200 == 0, "dev").otherwise("test"))
    grouped = evaluation.grouped_metrics(items, "baseline", "split", _BASELINE_METRICS)
    return grouped.select("baseline", "split", "n", *(F.round(m, 6).alias(m) for m in _BASELINE_METRICS))


@register()
def paired_interval(spark, sf_dir):
    """How much more the fused baseline recalls than the dense one, over items that both have, with its interval."""
    items = materialize(_measured(spark, sf_dir), "baseline-items")
    return evaluation.bootstrap_pairs(items, "query_id", "baseline", "recall_20", "B2_dense", "B3_fused")


@register()
def refusal_rate_interval(spark, sf_dir):
    """The share of answerable items that each baseline refuses, with its interval; all baselines share the draws."""
    items = _measured(spark, sf_dir).filter("answerable").select("query_id", "baseline", "over_refusal", F.lit(1.0).alias("asked"))
    return evaluation.bootstrap_rates(materialize(items, "baseline-items"), "query_id", "over_refusal", "asked", "baseline")


@register("""
SELECT event_type, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(value AS DOUBLE), 0.95), 6) AS p95 FROM events GROUP BY 1""")
def percentile_latency(spark, sf_dir):
    found = evaluation.percentiles(read(spark, sf_dir, "events"), "value", [0.5, 0.95], ["event_type"])
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@register()
def bootstrap_ci(spark, sf_dir):
    return evaluation.bootstrap_means(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", "event_type")


def _sectioned(spark, sf_dir) -> DataFrame:
    """Documents whose lines are sections, every third one with a heading of its own, titled by source and language."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    heading = lambda line, i: F.when(i % 3 == 0, F.substring(line, 1, 20)).when(i % 3 == 1, F.concat(F.lit("Part "), i.cast("string")))
    sections = F.transform(lines, lambda line, i: F.struct(heading(line, i).alias("heading"), line.alias("content")))
    facts = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source_name"), F.col("source"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang").alias("title"), "text", sections.alias("sections"), facts.alias("facts"))


@register()
def section_chunks(spark, sf_dir):
    """Chunks of all documents by section under heading, title and facts, without texts that an earlier document has."""
    chunks, _ = rechunking.rechunk(_sectioned(spark, sf_dir))
    return chunks.select("id", "document_id", "chunk_number", "section", "content_hash", "char_len")


@register()
def section_rejects(spark, sf_dir):
    """What re-chunking leaves out, by reason."""
    _, errors = rechunking.rechunk(_sectioned(spark, sf_dir))
    return errors.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))


# pages


@register("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, nullif(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), '') AS lang,
  length(trim(html)) >= 500 AND NOT regexp_matches(lower(html), 'captcha|access denied') AS valid FROM pages""")
def page_metadata(spark, sf_dir):
    return page_source.page_metadata(read(spark, sf_dir, "pages"))


@register(r"""
WITH q AS (SELECT doc_id AS id, [doc_id, doc_id + 1, -1] AS ids, [substring(text, 11, 40), substring(text, 1, 30), 'x'] AS quotes FROM documents),
e AS (SELECT id, i - 1 AS position, ids[i] AS document, quotes[i] AS quote FROM (SELECT *, unnest(range(1, 4)) AS i FROM q))
SELECT id, CAST(position AS INTEGER) AS position, CASE WHEN d.text IS NULL THEN 'missing_document'
  WHEN contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) THEN 'supported' ELSE 'quote_not_found' END AS status
FROM e LEFT JOIN documents d ON d.doc_id = document""")
def quote_containment(spark, sf_dir):
    """Quotes from each document against it, its neighbour and none."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    quotes = F.array(F.substring("text", 11, 40), F.substring("text", 1, 30), F.lit("x"))
    asked = docs.select("id", F.array(F.col("id"), F.col("id") + 1, F.lit(-1).cast("long")).alias("document_ids"), quotes.alias("quotes"))
    return evaluation.quote_support(asked, docs)


@register("""
SELECT user_id, round(max(CASE WHEN event_type = 'click' THEN value END) - max(CASE WHEN event_type = 'view' THEN value END), 6) AS delta
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 HAVING count(DISTINCT event_type) = 2""")
def paired_baseline_delta(spark, sf_dir):
    deltas = evaluation.paired_deltas(read(spark, sf_dir, "events"), "user_id", "event_type", "value", "view", "click")
    return deltas.select("user_id", F.round("delta", 6).alias("delta"))


@register(_DENSE.format(where="WHERE label = 1", k=10) + """,
every AS (SELECT * FROM (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0, least(1, list_cosine_similarity(qe, e))), 9) DESC, vec_id) AS INTEGER) AS rank FROM q, v) WHERE rank <= 10),
f AS (SELECT query_id, vec_id, rank FROM dense WHERE query_id % 200 = 0)
SELECT query_id, vec_id, rank, false AS relaxed FROM f
UNION ALL SELECT query_id, vec_id, rank, true FROM every WHERE query_id NOT IN (SELECT query_id FROM f)""")
def filter_relaxation(spark, sf_dir):
    """Searches of which half have a filter that leaves nothing, relaxed for those."""
    filtered = _dense(spark, sf_dir, 10, F.col("label") == 1).filter("query_id % 200 = 0").select("query_id", "vec_id", "rank")
    return retrieval.relaxed(filtered, _dense(spark, sf_dir, 10).select("query_id", "vec_id", "rank"))


@register("""
SELECT user_id AS attempt, max(value) FILTER (WHERE event_type = 'purchase') AS rerank_score, count(*) AS n FROM events GROUP BY 1""")
def attempt_strength(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("attempt"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("rerank_score"), F.col("value").alias("score"))
    return retrieval.strength(rows, "attempt").select("attempt", "rerank_score", "n")


@register("""
SELECT event_id FROM events WHERE (event_type = 'purchase' AND value >= 10) OR CAST(ts AS TIMESTAMP) > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 48 HOURS""")
def cache_freshness(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "matched").otherwise("no_match")
    dated = F.when(F.col("value") >= 10, F.lit("2024-01-01"))
    cache = read(spark, sf_dir, "events").select("event_id", status.alias("status"), dated.alias("release_date"), F.col("ts").alias("fetched_at"))
    return relational.fresh(cache, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 48).select("event_id")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def resume_unfinished(spark, sf_dir):
    state = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("failed").alias("status"))
    return relational.unfinished(read(spark, sf_dir, "orders").select("o_orderkey"), state, "o_orderkey")


@register("""
SELECT doc_id, array_to_string([e FOR e IN [CASE WHEN trim(text) = '' THEN 'empty_question' END, CASE WHEN longest > 25 THEN 'quote_too_long' END,
  CASE WHEN contains(lower(text), 'license') THEN 'domain_term' END] IF e IS NOT NULL], ',') AS errors
FROM (SELECT doc_id, text, list_max([len(regexp_extract_all(regexp_replace(q, '[^ -~]', ' ', 'g'), '\\b[\\w''-]+\\b')) FOR q IN string_split(text, chr(10))]) AS longest
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""")
def question_rules(spark, sf_dir):
    """Every document as a question whose quotes are its lines, whole texts in every language."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("question"))
    quotes = F.transform(F.split("question", "\n", -1), lambda q: F.regexp_replace(q, "[^ -~]", " "))
    asked = docs.select("doc_id", "question", F.lit(True).alias("answerable"), F.transform(quotes, lambda q: F.col("doc_id")).alias("document_ids"), quotes.alias("quotes"))
    found = evaluation.question_errors(asked, 25, "license")
    return found.select("doc_id", F.array_join("errors", ",").alias("errors"))


@register("""
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN toxic IS NULL THEN 'unsupported' WHEN quality = 1 AND toxic = 0 THEN 'match' ELSE 'mismatch' END AS status
  FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def seed_audit_histogram(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic").isNull(), "unsupported").when((F.col("quality") == 1) & (F.col("toxic") == 0), "match").otherwise("mismatch")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@register("""
SELECT event_id, round(1 / (1 + exp(-(value - 25) / 10)), 6) AS confidence, value >= 20.5 AS confident FROM events""")
def confidence_gate(spark, sf_dir):
    score = T.sigmoid((F.col("value") - 25) / 10)
    return read(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("confidence"), (F.col("value") >= 20.5).alias("confident"))


@register(f"""{_RUNS}, s AS (SELECT query_id, n, count(*) FILTER (WHERE hit AND rank <= 5) AS k, query_id % 400 <> 0 AS answerable FROM hits GROUP BY 1, 2)
SELECT query_id, CASE WHEN answerable THEN CAST(k = n AS DOUBLE) END AS answer_support_5, CASE WHEN answerable THEN CAST(k > 0 AS DOUBLE) END AS citation_valid_5,
  CASE WHEN NOT answerable THEN CAST(query_id % 300 = 0 AS DOUBLE) END AS correct_refusal, CASE WHEN answerable THEN CAST(query_id % 300 = 0 AS DOUBLE) END AS over_refusal FROM s""")
def support_metrics(spark, sf_dir):
    """Support, citation and refusal of the neighbour searches, some of them taken for unanswerable or refused."""
    items = _items(spark, sf_dir).withColumns({"answerable": F.col("query_id") % 400 != 0, "refused": F.col("query_id") % 300 == 0})
    return evaluation.support_metrics(items).select("query_id", "answer_support_5", "citation_valid_5", "correct_refusal", "over_refusal")


@register("""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'invalid_chunk_number' WHEN coalesce(text, '') = '' THEN 'empty_text' WHEN length(text) < 600 THEN 'chunk_below_minimum' END AS reason
FROM documents""")
def chunk_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", chunking.chunk_reason(F.col("doc_id").cast("string"), F.col("doc_id") % 7 - 1, F.col("text"), 600).alias("reason"))


@register(r"""
WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '"' || p_name || '" (' || (1950 + p_size) || ') Film' WHEN 1 THEN p_name || ' ' || (1950 + p_size) || ' movie?' ELSE ' The Film. ' END AS raw FROM part),
c AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '\(\s*(?:19|20)\d{2}\s*\)', '', 'g'), '(?i)\b(?:movie|film)\b\s*$', ''), ' "''?.!' || chr(9) || chr(10) || chr(13)) AS candidate FROM r)
SELECT p_partkey, candidate, TRY_CAST(nullif(regexp_extract(raw, '\b((?:19|20)\d{2})\b', 1), '') AS INTEGER) AS year,
  lower(candidate) IN ('a', 'a film', 'a movie', 'an', 'film', 'films', 'movie', 'movies', 'the', 'the film', 'the movie') AS generic FROM c""")
def title_candidates(spark, sf_dir):
    """Titles as questions name them, cleaned, with their year and whether they name no film at all."""
    dated = (F.col("p_size") + 1950).cast("string")
    raw = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"'), "p_name", F.lit('" ('), dated, F.lit(") Film")))
        .when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" "), dated, F.lit(" movie?")))
        .otherwise(" The Film. ")
    )
    cut = T.title_candidate(raw)
    return read(spark, sf_dir, "part").select("p_partkey", cut.alias("candidate"), T.year_in(raw).alias("year"), lookup.is_generic(cut).alias("generic"))


@register("""
WITH a AS (SELECT p_partkey, p_name, 1950 + p_size AS year, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' (film)' WHEN 1 THEN p_name || ' (' || (1950 + p_size) || ')' WHEN 2 THEN p_name ELSE 'List of films' END AS article FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND contains(page, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))) AND (contains(page, CAST(year AS VARCHAR)) OR contains(page, 'film')) THEN article END AS article
FROM (SELECT *, trim(regexp_replace(lower(article), '[^a-z0-9]+', ' ', 'g')) AS page FROM a)""")
def article_enrichment(spark, sf_dir):
    """Parts with the article found for them, kept only where its title is a confident match; some have none."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") + 1950).alias("year"))
    key = F.col("p_partkey") % 4
    named = F.when(key == 0, F.concat(F.upper("p_name"), F.lit(" (film)"))).when(key == 1, F.concat("p_name", F.lit(" ("), F.col("year").cast("string"), F.lit(")")))
    articles = parts.filter("p_partkey % 5 <> 0").select("p_partkey", named.when(key == 2, F.col("p_name")).otherwise("List of films").alias("article"))
    return lookup.with_articles(parts, articles, "p_partkey", "p_name", "year", "article").select("p_partkey", "article")


@register(r"""
WITH a AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'release_date' ELSE 'title' END AS field,
    CASE p_partkey % 3 WHEN 0 THEN '1 hour ' || p_size || ' minutes' WHEN 1 THEN 'It came out on May ' || p_size || ', 1999.' ELSE 'The ' || p_name || ' by ' || p_brand END AS expected,
    CASE p_partkey % 3 WHEN 0 THEN (60 + p_size + p_partkey % 2) || ' min' WHEN 1 THEN 'may ' || p_size || ', ' || (1999 + p_partkey % 2) ELSE CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_type END END AS canonical FROM part),
w AS (SELECT *, string_split(trim(regexp_replace(lower(expected), '[^a-z0-9]+', ' ', 'g')), ' ') AS said,
    [t FOR t IN string_split(trim(regexp_replace(lower(canonical), '[^a-z0-9]+', ' ', 'g')), ' ') IF length(t) > 1] AS tokens FROM a)
SELECT p_partkey, field, CASE field
  WHEN 'runtime' THEN CAST(regexp_extract(expected, '(\d+) hour', 1) AS INTEGER) * 60 + CAST(regexp_extract(expected, '(\d+) minute', 1) AS INTEGER) = CAST(regexp_extract(canonical, '\d+') AS INTEGER)
  WHEN 'release_date' THEN contains(lower(expected), lower(canonical)) ELSE len(tokens) > 0 AND list_has_all(said, tokens) END AS agrees FROM w""")
def seed_field_match(spark, sf_dir):
    """Answers on parts against their records by the rule of each field, some of them wrong."""
    odd, third = F.col("p_partkey") % 2, F.col("p_partkey") % 3
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    size, name = F.col("p_size"), F.col("p_name")
    by_field = lambda *values: F.when(third == 0, values[0]).when(third == 1, values[1]).otherwise(values[2])
    field = by_field("runtime", "release_date", "title")
    expected = by_field(text("1 hour ", size, " minutes"), text("It came out on May ", size, ", 1999."), text("The ", name, " by ", F.col("p_brand")))
    canonical = by_field(text(size + 60 + odd, " min"), text("may ", size, ", ", odd + 1999), F.when(odd == 0, F.upper(name)).otherwise(F.col("p_type")))
    return read(spark, sf_dir, "part").select("p_partkey", field.alias("field"), evaluation.field_matches(field, expected, canonical).alias("agrees"))


@register("""
SELECT p_partkey, 'Movie: ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Quick facts: Brand: ' || p_brand || ' | Part Type: ' || p_type ELSE '' END || chr(10) || chr(10) || p_type AS text FROM part""")
def chunk_enrichment(spark, sf_dir):
    facts = F.create_map(F.lit("part_type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))
    text = T.enriched(F.col("p_type"), F.col("p_name"), facts, F.col("p_partkey") % 2 == 0)
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@register(r"""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'r' ELSE 'tt' END || p_partkey AS imdb_id, p_name AS title,
  CASE p_partkey % 4 WHEN 0 THEN 1950 + p_size WHEN 1 THEN 1999 END AS year, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_retailprice AS DOUBLE) END AS imdb_rating,
  CASE p_partkey % 3 WHEN 2 THEN '' ELSE p_type || '|' || p_brand END AS genres, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS names,
  CASE p_partkey % 5 WHEN 0 THEN 'https://films/' || p_partkey WHEN 4 THEN '' ELSE 'https://own/' || p_partkey END AS url FROM part""")
def record_normalisation(spark, sf_dir):
    """Parts written as loose JSON (lists or texts between commas, numbers as texts, objects that are none), normalised and
    shown as callers see them.
    """
    key = F.col("p_partkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    pick = lambda n, *values: F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), (key % n).cast("int") + 1)
    fields = {
        "imdb_id": pick(3, '""', *[quoted(text(" tt", key, " "))] * 2), "id": quoted(text("r", key)), "title": quoted(text(" ", F.col("p_name"), "\n")),
        "year": pick(4, text(F.col("p_size") + 1950), '" 1999 "', '"n/a"', "null"), "imdb_rating": pick(2, text(F.col("p_retailprice")), '"unrated"'),
        "genres": pick(3, text("[", quoted(F.col("p_type")), ', " ", null, ', quoted(F.col("p_brand")), "]"), quoted(text(F.col("p_type"), ", ", F.col("p_brand"), ",,")), "7"),
        "top_cast": pick(2, text('[{"name": ', quoted(F.col("p_name")), '}, {"name": " "}, 5, null]'), '"none"'),
        "source_urls": pick(5, text('{"imdb": "https://films/', key, '"}'), '{"imdb": ""}', '"text"', "[]", "null"),
        "url": pick(5, *[quoted(text("https://own/", key))] * 4, "null"),
    }
    body = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{name}": '), value) for name, value in fields.items())), F.lit("}"))
    rows = records.normalized(read(spark, sf_dir, "part").select("p_partkey", F.parse_json(body).alias("record")))
    names = F.array_join(F.transform("top_cast", lambda person: records.text_at(person, "name")), "|").alias("names")
    shown = records.public(rows.withColumn("overview", F.col("p_partkey").cast("string")))
    return shown.select(F.col("overview").cast("long").alias("p_partkey"), "imdb_id", "title", "year", "imdb_rating", F.array_join("genres", "|").alias("genres"), names, "url")


@register("""
SELECT p_partkey, 'qf_brand_name=' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '|qf_part=' || p_type END || '|qf_size=' || p_size AS fields FROM part""")
def metadata_keys(spark, sf_dir):
    """Facts of parts under keys that an index takes; two keys become equal, and a null value goes."""
    facts = F.create_map(
        F.lit("Size (cm)"), F.lit("0"), F.lit("-size-"), F.col("p_size").cast("string"), F.lit("Brand Name"), F.col("p_brand"),
        F.lit("__Part"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")),
    )
    facts = F.map_filter(facts, lambda k, _: k != "Size (cm)")
    pairs = F.array_sort(F.transform(F.map_entries(records.metadata_fields(facts)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(pairs, "|").alias("fields"))


@register(r"""
WITH i AS (SELECT doc_id, coalesce(text, '') AS text, 'q' || (doc_id - CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END) AS id,
    CASE doc_id % 7 WHEN 0 THEN 'single_hop' WHEN 1 THEN 'multi_hop' WHEN 2 THEN 'comparative' WHEN 3 THEN 'temporal' WHEN 4 THEN 'unanswerable' WHEN 5 THEN 'ambiguous_adversarial' ELSE 'other' END AS category,
    CASE WHEN doc_id % 31 = 0 THEN 'train' WHEN doc_id % 5 < 3 THEN 'dev' ELSE 'test' END AS split, doc_id % 37 <> 0 AS flags, doc_id % 7 <> 4 AS open FROM documents),
e AS (SELECT id, 'unsupported_category' AS error FROM i WHERE category = 'other'
  UNION ALL SELECT id, 'split_must_be_dev_or_test' FROM i WHERE split = 'train'
  UNION ALL SELECT id, 'flag_must_be_true_or_false' FROM i WHERE NOT flags
  UNION ALL SELECT id, 'documents_and_urls_must_align' FROM i WHERE flags AND open AND doc_id % 9 = 0
  UNION ALL SELECT id, 'multi_hop_needs_two_documents' FROM i WHERE flags AND doc_id % 7 = 1 AND doc_id % 2 = 0
  UNION ALL SELECT id, 'evidence_without_answer' FROM i WHERE flags AND NOT open
  UNION ALL SELECT id, 'searched_for_missing' FROM i WHERE flags AND NOT open AND doc_id % 3 = 0
  UNION ALL SELECT id, 'duplicate_id' FROM i GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT id, 'unknown_document' FROM i WHERE flags AND open AND doc_id % 11 = 0
  UNION ALL SELECT id, 'quote_not_found' FROM i WHERE flags AND open AND doc_id % 11 <> 0 AND doc_id % 13 = 0
  UNION ALL SELECT id, CASE WHEN n.doc_id IS NULL THEN 'unknown_document' ELSE 'quote_not_found' END FROM i LEFT JOIN (SELECT DISTINCT doc_id FROM documents) n ON n.doc_id = i.doc_id + 1
    WHERE flags AND i.doc_id % 7 = 1 AND i.doc_id % 2 = 1
  UNION ALL SELECT NULL, 'split_is_not_60_40' FROM (SELECT count(*) AS n, count(*) FILTER (split = 'dev') AS d, count(*) FILTER (split = 'test') AS t FROM i) WHERE d <> round(n * 0.6) OR t <> n - round(n * 0.6))
SELECT id, error, count(*) AS n FROM e GROUP BY 1, 2""")
def golden_audit(spark, sf_dir):
    """The rules of a golden set on a question of each document, with evidence looked up in the documents; many break one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key, name = F.col("doc_id"), F.col("doc_id").cast("string")
    kind = F.element_at(F.array(*map(F.lit, [*golden.MINIMA, "other"])), (key % 7).cast("int") + 1)
    two = (key % 7 == 1) & (key % 2 == 1)
    first = F.when(key % 11 == 0, "none").otherwise(name)
    quote = F.when(key % 13 == 0, "\u0001").otherwise(F.upper(F.concat(F.lit(" "), F.substring("text", 5, 30), F.lit("\n"))))
    documents = F.when(two, F.array(first, (key + 1).cast("string"))).otherwise(F.array(first))
    items = docs.select(
        F.concat(F.lit("q"), F.when(key % 50 == 1, key - 1).otherwise(key).cast("string")).alias("id"), kind.alias("category"),
        F.when(key % 31 == 0, "train").when(key % 5 < 3, "dev").otherwise("test").alias("split"),
        F.when(key % 37 == 0, "maybe").when(key % 7 == 4, "false").otherwise(" TRUE").alias("answerable"), F.lit("true").alias("human_verified"), F.lit("yes").alias("gold_answer"),
        documents.alias("document_ids"), F.when(key % 9 == 0, F.array().cast("array<string>")).otherwise(documents).alias("source_urls"),
        F.when(two, F.array(quote, F.lit("\u0001"))).otherwise(F.array(quote)).alias("quotes"), F.when((key % 7 == 4) & (key % 3 != 0), "it").otherwise("").alias("searched_for"),
    )
    found = golden.errors(items, docs.select(name.alias("id"), "text"))
    found = found.filter("NOT (id IS NULL AND (error LIKE 'too_few%' OR error LIKE 'no_%'))")  # what a small table lacks
    return found.groupBy("id", "error").agg(F.count("*").alias("n"))


@register(r"""
WITH r AS (SELECT p_name AS title, min(p_size) AS size, min(p_brand) AS brand, min(p_type) AS kind FROM part GROUP BY 1),
q AS (SELECT p_partkey AS query_id, p_partkey % 2 AS odd, p_partkey % 5 AS ask, CASE WHEN p_partkey % 13 = 0 THEN 'What is the runtime?' ELSE
    CASE p_partkey % 5 WHEN 0 THEN 'What is the Release Date of ' WHEN 1 THEN 'Who directed ' WHEN 2 THEN 'What is the runtime of ' WHEN 3 THEN 'Who wrote ' ELSE 'Where is ' END || upper(p_name) || '?' END AS query FROM part),
l AS (SELECT query_id, arg_max(title, {'n': length(title), 't': title}) AS title FROM q LEFT JOIN r ON contains(lower(query), lower(title)) GROUP BY 1)
SELECT query_id, title, CASE WHEN title IS NULL THEN '' ELSE ['release_date', 'directors', 'runtime', 'writers', 'unknown'][ask + 1] END AS field,
  CASE WHEN title IS NULL THEN '' ELSE [strftime(DATE '1990-01-01' + size, '%B %-d, %Y'), brand || ', ' || kind, (size + 60) || ' minutes', '', ''][ask + 1] END AS answer,
  CASE WHEN title IS NULL THEN 'title_not_found' WHEN ask = 4 THEN 'unsupported_question_pattern' WHEN ask = 3 THEN 'gold_not_supported_by_corpus'
    WHEN odd = 0 THEN 'matches_corpus' ELSE 'mismatch' END AS status
FROM q JOIN l USING (query_id) LEFT JOIN r USING (title)""")
def seed_audit(spark, sf_dir):
    """Questions on parts, half of them with wrong answers, against the records that they name."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type")
    grouped = parts.groupBy(F.col("p_name").alias("title")).agg(F.min("p_size").alias("size"), F.min("p_brand").alias("brand"), F.min("p_type").alias("kind"))
    none, least = F.array().cast("array<string>"), F.col("size")
    films = grouped.select(
        "title", F.date_add(F.lit("1990-01-01").cast("date"), least).alias("release_date"), F.array("brand", "kind").alias("directors"), none.alias("writers"),
        (least + 60).alias("runtime"), none.alias("genres"), none.alias("top_cast"), F.lit("").alias("overview"), "size", "brand", "kind",
    )
    key = F.col("p_partkey")
    asks = F.element_at(F.array(*map(F.lit, ["What is the Release Date of ", "Who directed ", "What is the runtime of ", "Who wrote ", "Where is "])), (key % 5).cast("int") + 1)
    query = F.when(key % 13 == 0, "What is the runtime?").otherwise(F.concat(asks, F.upper("p_name"), F.lit("?")))
    right = F.concat(F.lit("On "), F.date_format("release_date", "MMMM d, yyyy"), F.lit(" by "), "kind", F.lit(" and "), "brand", F.lit(", 1 hour "), F.col("size").cast("string"), F.lit(" minutes"))
    asked = parts.join(films.select(F.col("title").alias("p_name"), right.alias("right")), "p_name")
    asked = asked.select(key.alias("query_id"), query.alias("query"), F.when(key % 2 == 0, F.col("right")).otherwise("Nobody knows").alias("expected"))
    return golden.seed_audit(asked, films.drop("size", "brand", "kind"))


@register(r"""
WITH r AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS said FROM documents),
c AS (SELECT doc_id AS line, CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'c' || (doc_id - CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END) END AS id,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE said END AS text, said, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 1 END AS generation, doc_id % 5 AS chunk_number FROM r),
e AS (SELECT *, CASE WHEN line % 29 = 0 THEN 'chunk_must_be_an_object' WHEN id = '' THEN 'missing_chunk_id' WHEN text = '' THEN 'empty_text' WHEN line % 11 = 0 THEN 'missing_content_hash'
    WHEN line % 7 = 0 THEN 'content_hash_mismatch' WHEN generation IS NULL THEN 'invalid_operational_metadata' END AS error FROM c),
f AS (SELECT id, min(line) AS line FROM e WHERE error IS NULL GROUP BY 1)
SELECT e.line, CASE WHEN e.line % 29 = 0 THEN '' ELSE e.id END AS id, CASE WHEN e.error IS NULL AND f.line IS NULL THEN 'duplicate_chunk_id' ELSE e.error END AS error,
  CASE WHEN e.line % 29 <> 0 THEN e.chunk_number END AS chunk_number, CASE WHEN e.line % 29 = 0 THEN 0 ELSE length(e.text) END AS n_chars
FROM e LEFT JOIN f ON e.line = f.line""")
def ingest_checks(spark, sf_dir):
    """Each document written as a loose chunk, many with a fault, and the first rule that it breaks."""
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    digest = F.sha2(records.stripped(text), 256)
    chunk = F.struct(
        F.when(key % 17 == 0, " ").otherwise(F.concat(F.lit("c"), F.when(key % 50 == 1, key - 1).otherwise(key).cast("string"), F.lit(" "))).alias("id"),
        F.when(key % 13 == 0, "\n").otherwise(text).alias("text"), F.when(key % 11 == 0, "").when(key % 7 == 0, "0").otherwise(digest).alias("content_hash"),
        F.when(key % 19 == 0, "first").otherwise("1").alias("generation"), (key % 5 + 0.5).alias("chunk_number"),
    )
    body = F.when(key % 29 == 0, "[1]").otherwise(F.to_json(chunk))
    rows = read(spark, sf_dir, "documents").select(key.alias("line"), F.parse_json(body).alias("chunk"))
    return ingest.checked(rows).select("line", "id", "error", "chunk_number", F.char_length("text").cast("long").alias("n_chars"))


# what plain SQL calls


@register(r"""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, len(words) AS n, word, count(*) AS tf FROM (SELECT doc_id, words, unnest(words) AS word FROM w) GROUP BY ALL),
d AS (SELECT word, count(*) AS holding FROM t WHERE word IN ('the', 'model', 'data') GROUP BY 1)
SELECT doc_id, round(sum(greatest(ln(((SELECT count(*) FROM w) - holding + 0.5) / (holding + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT avg(len(words)) FROM w)))), 6) AS score
FROM t JOIN d USING (word) GROUP BY 1""")
def sql_bm25(spark, sf_dir):
    """BM25 of three words over all texts, in plain SQL with the helper functions; the idf is bounded below."""
    extension.register(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = spark.sql("SELECT doc_id, split(plain_words(text), ' ') AS words FROM {docs} WHERE text IS NOT NULL", docs=docs)
    each = spark.sql("SELECT doc_id, size(words) AS n, explode(words) AS word FROM {words}", words=words)
    posted = spark.sql("SELECT doc_id, n, word, count(*) AS tf FROM {each} WHERE word IN ('the', 'model', 'data') GROUP BY ALL", each=each)
    texts = spark.sql("SELECT count(*) AS texts, avg(size(words)) AS avg_len FROM {words}", words=words)  # one row
    holding = spark.sql("SELECT word, count(*) AS holding FROM {posted} GROUP BY word", posted=posted).join(F.broadcast(texts))  # three rows
    met = posted.join(F.broadcast(holding), "word")
    parts = spark.sql("SELECT doc_id, bm25_idf(texts, holding) * bm25_weight(tf, n, avg_len) AS part FROM {met}", met=met)
    return spark.sql("SELECT doc_id, round(sum(part), 6) AS score FROM {parts} GROUP BY doc_id", parts=parts)


@register("""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_number, length(c) AS n_chars, CAST(ceil(length(c) / 4.0) AS BIGINT) AS n_tokens FROM (
  SELECT doc_id, i, substring(text, i * 700 + 1, 700) AS c
  FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 700.0) AS BIGINT), 1))) AS i FROM documents)) WHERE trim(c) <> ''""")
def sql_fixed_chunks(spark, sf_dir):
    """Windows of all texts by a table function of plain SQL."""
    extension.register(spark)
    return spark.sql(
        "SELECT doc_id, c.chunk_number, CAST(char_length(c.text) AS BIGINT) AS n_chars, chunk_tokens(c.text) AS n_tokens FROM {documents}, LATERAL fixed_chunks(text, 700) AS c",
        documents=read(spark, sf_dir, "documents").select("doc_id", "text"),
    )


@register()
def sql_section_chunks(spark, sf_dir):
    """Chunks of all documents, their lines as sections, by a table function partitioned by document."""
    extension.register(spark)
    lines = _sectioned(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.posexplode("sections").alias("n", "s")).select("id", "n", "s.heading", "s.content")
    return spark.sql("SELECT id, pos, section, sha2(text, 256) AS text_sha256 FROM section_chunks(TABLE({lines}) PARTITION BY id ORDER BY n)", lines=lines)
