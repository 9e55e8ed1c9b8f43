"""Benchmark decontamination in DataFrame operations: windows of item words, probed at every word of every document."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.picking import free_name, pick
from tessella.storage import materialize

WINDOW = 10
HEAD = 3
#: Windows of up to so many bytes in all, WINDOW_BYTES added for each, are broadcast; beyond it hashes of windows are shuffled.
BROADCAST_BYTES, WINDOW_BYTES = 32 << 20, 100
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same for a text as it is, with its capitals.
RAW_SEPARATOR, RAW_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; lower() does just that where a text has only ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words_of(text: Column) -> Column:
    """A text's words in order; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, size, head, gram): windows of `window` words; a shorter item that has words is one window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window)))
    starts = items.select("item_id", "size", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    grams = starts.select("item_id", "size", F.slice("words", F.col("at"), F.col("size")).alias("gram"))
    return grams.select(
        "item_id",
        "size",
        F.least(F.col("size"), F.lit(HEAD)).alias("head_size"),
        F.array_join(F.slice("gram", 1, HEAD), " ").alias("head"),
        F.array_join("gram", " ").alias("gram"),
    ).distinct()


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs`: doc_id, text_hash, n_words, spans (array of struct<start, stop>, merged, in words from 0, stop
    exclusive) and item_ids.

    Item windows are stored and their bytes counted first. Up to BROADCAST_BYTES they are broadcast and met in one pass over
    the texts: each word is probed by its head, the first words of a window; where a head is found the whole window is
    compared. Beyond it every window of a text is shuffled as a hash, and hits are compared with their texts. Null and
    empty texts have no words; rows that repeat a doc_id, or have none, are documents of their own. No items: no spans.
    """
    grams = materialize(item_windows(benchmark, window), "item-windows")
    facts = grams.agg(F.sum(F.octet_length("gram") + WINDOW_BYTES).alias("bytes")).first()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    texts = texts.withColumn("n_words", F.size("words"))
    documents = (_met_by_head if (facts["bytes"] or 0) <= BROADCAST_BYTES else _met_by_hash)(texts, grams)
    found = documents.select("doc_id", "text_hash", "n_words", merged("places").alias("spans"), "item_ids", F.array_repeat(F.lit(1), F.col("rows").cast("int")).alias("rows"))
    return found.withColumn("rows", F.explode("rows")).drop("rows")  # equal rows have met in one group


def _place(at: Column, size: Column) -> Column:
    return F.when(size.isNotNull(), F.struct((at - 1).alias("start"), (at - 1 + size).alias("stop")))


def _met_by_head(texts: DataFrame, grams: DataFrame) -> DataFrame:
    lengths = [r[0] for r in grams.select("head_size").distinct().limit(HEAD).collect()]
    at, known = F.col("at"), ["doc_id", "text_hash", "n_words"]
    # at = 0 stands for the document itself, so that one without a hit keeps its row
    places = texts.select(*known, "words", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("at"))
    found = []
    for length in sorted(lengths) or [HEAD]:
        word = [F.get("words", at - 1 + k) for k in range(length)]
        whole = (at >= 1) & (at + length - 1 <= F.col("n_words"))
        probe = places.withColumn("probe", F.when(whole, F.concat_ws(" ", *word)))
        if found:
            probe = probe.filter(at >= 1)
        heads = grams.filter(F.col("head_size") == length).select(F.col("head"), F.col("size")).distinct()
        at_head = probe.join(F.broadcast(heads), F.col("probe") == F.col("head"), "left").filter((at == 0) | F.col("size").isNotNull())
        at_head = at_head.select(
            *known,
            "at",
            F.when(at + F.col("size") - 1 <= F.col("n_words"), F.array_join(F.slice("words", at, F.col("size")), " ")).alias("text_gram"),
        )
        sized = grams.filter(F.col("head_size") == length).select("item_id", F.col("size").alias("gram_size"), "gram")
        hits = at_head.join(F.broadcast(sized), F.col("text_gram") == F.col("gram"), "left").filter((at == 0) | F.col("item_id").isNotNull())
        found.append(hits.select(*known, "at", "gram_size", "item_id"))
    rows = reduce(DataFrame.unionByName, found)
    return rows.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(_place(at, F.col("gram_size")))).alias("places"),
        F.collect_set("item_id").alias("item_ids"),
        F.count_if(at == 0).alias("rows"),
    )


def _met_by_hash(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """What stands in a text depends on its text alone, so hits are kept by the text's hash."""
    sizes = [r[0] for r in grams.select("size").distinct().collect()]  # as many as a window has words, at most
    at = F.col("at")
    windows = []
    for size in sorted(sizes) or [WINDOW]:
        starts = F.explode(F.sequence(F.lit(1), F.col("n_words") - size + 1)).alias("at")
        own = texts.filter(F.col("n_words") >= size).select("text_hash", "words", starts)
        windows.append(own.select("text_hash", "at", F.lit(size).alias("size"), F.xxhash64(F.array_join(F.slice("words", at, size), " ")).alias("sign")))
    signs = grams.select("size", F.xxhash64("gram").alias("sign")).distinct()
    met = materialize(reduce(DataFrame.unionByName, windows).join(signs, ["size", "sign"]).select("text_hash", "at", "size").distinct(), "met-windows")
    # compared with the texts: a hash can lie
    those = texts.join(met.select("text_hash").distinct(), "text_hash", "left_semi").select("text_hash", "words").dropDuplicates(["text_hash"])
    own = met.join(those, "text_hash").select("text_hash", "at", "size", F.array_join(F.slice("words", at, F.col("size")), " ").alias("gram"))
    hits = own.join(grams.select("size", "gram", "item_id"), ["size", "gram"]).groupBy("text_hash")
    hits = hits.agg(F.array_sort(F.collect_set(_place(at, F.col("size")))).alias("places"), F.collect_set("item_id").alias("item_ids"))
    rows = texts.groupBy("doc_id", "text_hash").agg(F.max("n_words").cast("long").alias("n_words"), F.count("*").alias("rows"))
    joined = rows.join(hits, "text_hash", "left")
    empty = joined.select("*").withColumn("places", F.coalesce("places", F.array().cast("array<struct<start:int,stop:int>>")))
    return empty.withColumn("item_ids", F.coalesce("item_ids", F.array().cast(hits.schema["item_ids"].dataType)))


def merged(places: str) -> Column:
    """Sorted spans, overlapping and touching ones as one."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(done: Column, place: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], place["stop"]).alias("stop"))
        touching = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["stop"] >= place["start"])
        return F.when(
            touching, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        ).otherwise(F.concat(done, F.array(F.struct(place["start"].alias("start"), place["stop"].alias("stop")))))

    return F.aggregate(places, empty, add)


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, spans_only: bool = False, window: int = WINDOW) -> DataFrame:
    """Documents without benchmark passages, with the columns of `docs`.

    By default a document with a hit goes whole; with spans_only its hit words go, each with the separators after it,
    and the rest of the text stays. Hits are looked up by the text's hash, so a null doc_id is no hindrance.
    """
    hits = contaminated_words(docs, benchmark, window).filter(F.size("spans") > 0).dropDuplicates(["text_hash"])
    key, own = free_name(docs, "text_hash"), free_name(docs, "spans")
    hits, keyed = hits.select(F.col("text_hash").alias(key), F.col("spans").alias(own)), docs.withColumn(key, F.xxhash64("text"))
    if not spans_only:
        return pick(keyed, hits, [key], "left_anti").select(*docs.columns)
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"({RAW_WORD}+{RAW_SEPARATOR}*)"), 1)
    outside = F.filter(pieces, lambda piece, i: ~F.exists(own, lambda s: (i >= s["start"]) & (i < s["stop"])))
    lead = F.regexp_extract("text", f"^({RAW_SEPARATOR}*)", 1)
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(outside, "")))
    return keyed.join(hits, key, "left").select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns))


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document; a null text has no words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminated_words(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    n_hit = hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> ''] AS w FROM documents),
items AS (
  SELECT item_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> ''] AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS size FROM items WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS gram
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM sized)),
sizes AS (SELECT DISTINCT size FROM grams),
places AS (
  SELECT doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM words, sizes WHERE len(w) >= size)),
hits AS (SELECT p.doc_id, p.pos, p.size, g.item_id FROM places p JOIN grams g ON g.gram = p.gram AND g.size = p.size),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(words.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
