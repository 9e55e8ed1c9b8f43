"""MinHash near-duplicates with tensored banding.

A table's key pairs two sub-hashes out of COLLECTIONS small collections of ROWS minhashes each: 66 tables of four minhashes
a key come from 24 minhashes instead of 264. Two sets of similarity 0.8 share a sub-hash with probability 0.64 and become
candidates when two of the twelve agree, all but once in 9,000 pairs.

Candidates are verified on full sets, in three steps, after each of which the links found make components. Each set is
compared first with the smallest id that any of its buckets holds; then with the smallest ids of all its buckets that lie in
another component; last, in the buckets that still hold several components, with every set of another component, unless bounds
prove that it is not near: their sizes without the shingles that no other such set has, and the parities of their shingles
in SKETCH cells, which differ in no more cells than the sets differ in shingles. Nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import byte_slices, utf8_of
from tessella.llm.components import connected_components
from tessella.llm.picking import BROADCAST_KEYS, HOT_KEYS, HOT_ROWS, pick
from tessella.llm.shingles import scramble, shingle_hashes, word_hashes
from tessella.storage import materialize

SHINGLE_WORDS = 5
THRESHOLD = 80  # per cent
COLLECTIONS, ROWS = 12, 2
SKETCH = 512
SLICE_BYTES = 2 << 20
#: Shingles of a text that are hashed at once.
STRIDE = 1 << 15
#: Hubs that more pairs have are copied for so many parts of their pairs.
SALTS = 32
#: Sets of a bucket that one task compares with the bucket's others.
BUCKET_ROWS = 4096

_SEEDS = scramble(np.arange(1, 2 * COLLECTIONS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _FACTOR = _SEEDS[: COLLECTIONS * ROWS, None], _SEEDS[COLLECTIONS * ROWS :, None] | np.uint64(1)


def _as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two sums over each set, which with its size stand for it."""
    return np.array([(s.sum(dtype=np.uint64), scramble(s).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2)


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", SLICE_BYTES):
        sets = shingle_hashes(*word_hashes(*utf8_of(batch)), size)
        digest = _digests(sets)
        subs = np.zeros((len(sets), COLLECTIONS), np.uint64)
        for i, s in enumerate(sets):
            if len(s):
                low = np.min([((s[k : k + STRIDE] ^ _XOR) * _FACTOR).min(axis=1) for k in range(0, len(s), STRIDE)], axis=0).reshape(COLLECTIONS, ROWS)
                subs[i] = scramble(low[:, 0] * np.uint64(0x9E3779B97F4A7C15) + low[:, 1])
        flat = pa.FixedSizeListArray.from_arrays(_as_long(subs.ravel()), COLLECTIONS).cast(pa.list_(pa.int64()))
        columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _as_long(digest[:, 0].copy()), _as_long(digest[:, 1].copy()), flat]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d1", "d2", "subs"])


def signatures(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, the set's digest (d1, d2) and its sub-hashes; a narrow pass."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(lambda b: _signed(b, size), "doc_id long, n_shingles long, d1 long, d2 long, subs array<long>")


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether each of SKETCH cells has an odd number of the shingles, in words of 64."""
    cells = np.bincount((scramble(shingles) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", SLICE_BYTES):
        sets = shingle_hashes(*word_hashes(*utf8_of(batch)), size)
        offsets = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _as_long(flat))
        bits = np.array([_sketch(s) for s in sets], np.uint64).reshape(-1, SKETCH // 64)
        digest = _digests(sets)
        own = [_as_long(digest[:, 0].copy()), _as_long(digest[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64())]
        columns = [*own, lists, *(_as_long(bits[:, i].copy()) for i in range(bits.shape[1]))]
        yield pa.RecordBatch.from_arrays(columns, names=[*SET, "shingles", *_BITS])


#: What tells sets apart.
SET = ["d1", "d2", "n_shingles"]
_BITS = [f"bits{i}" for i in range(SKETCH // 64)]


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(id, shingles, sketch words) of `nodes`, each read from a document (column doc) that has its set.

    A doc_id may have rows of other sets as well, so sets are told apart by their digests.
    """
    ids = materialize(nodes.select("doc").distinct(), "minhash-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted, "doc", "left_semi").select("text")
    kinds = ", ".join(f"{b} long" for b in _BITS)
    sets = texts.mapInArrow(lambda b: _sets(b, size), f"d1 long, d2 long, n_shingles long, shingles array<long>, {kinds}")
    return sets.dropDuplicates(SET).join(nodes.select("id", *SET), SET).select("id", "shingles", *_BITS)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b), a stored table, whose sets have 100 * intersection >= threshold * union.

    A hub b that many pairs share has its set copied SALTS times, and its pairs dealt among the copies.
    """
    counts = pairs.groupBy("b").count()
    bar = max(HOT_ROWS, pairs.count() // HOT_KEYS)
    hot = materialize(counts.filter(F.col("count") > bar).select("b", F.lit(SALTS).alias("salts")), "minhash-hubs")
    salt = F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    salted = pairs.join(F.broadcast(hot), "b", "left").select("a", "b", salt)
    left = salted.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    hubs = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")).join(F.broadcast(hot), "b", "left")
    hubs = hubs.select("b", "sb", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    both = left.join(hubs, ["b", "salt"])
    smaller, larger = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    near = both.filter(100 * smaller >= threshold * larger).select("a", "b", shared.alias("i"), (smaller + larger).alias("n"))
    return near.filter(100 * F.col("i") >= threshold * (F.col("n") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept.

    Equal sets are one node from the start, so groups of copies cost one row each. Null and empty texts have no shingles
    and link with nothing, nor does a null doc_id, whose component is null and which is kept. Rows that repeat a doc_id
    belong to the same document, which links with what any of them is near to; each gets its own row. What is kept does
    not depend on the order of rows.
    """
    signed = materialize(signatures(docs, size), "minhash-signatures")
    members = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = members.groupBy(*SET).agg(F.min("doc_id").alias("doc"), F.first("subs").alias("subs"))
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "minhash-nodes")
    edges = _links(docs, nodes, size, threshold).unionByName(_same_document(members, nodes))
    components = connected_components(edges)
    own = nodes.select(*SET, "id", "doc").join(components, "id", "left").withColumn("group", F.coalesce("component", "id"))
    least = own.groupBy("group").agg(F.min("doc").alias("component"))  # nodes have numbers of their own, groups the least doc_id
    classes = own.select(*SET, "group").join(least, "group").select(*SET, "component")
    rows = signed.select("doc_id", *SET).join(classes, SET, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _same_document(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the nodes of a doc_id that has rows of unlike sets; mostly none."""
    one = F.struct(*SET)
    unlike = members.groupBy("doc_id").agg(F.min(one).alias("a"), F.max(one).alias("b")).filter("a <> b").select("doc_id")
    rows = pick(members.select("doc_id", *SET), unlike, ["doc_id"]).distinct().join(nodes.select("id", *SET), SET).select("doc_id", "id")
    hubs = rows.groupBy("doc_id").agg(F.min("id").alias("b"))
    return rows.join(hubs, "doc_id").filter("id <> b").select(F.col("id").alias("a"), "b")


def keep_one_of_each(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` with one document of each group of near-duplicates, that of the smallest doc_id.

    Of rows that repeat a doc_id any one stays; null doc_ids, and documents without words, stay.
    """
    found = near_duplicates(docs, size, threshold)
    dropped = found.filter("NOT kept").select("doc_id").distinct()
    left = pick(docs, dropped, ["doc_id"], "left_anti").select(*docs.columns)
    twice = materialize(found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "minhash-repeated")
    if twice.isEmpty():
        return left
    return pick(left, twice, ["doc_id"], "left_anti").unionByName(pick(left, twice, ["doc_id"]).dropDuplicates(["doc_id"])).select(*docs.columns)


def _links(docs: DataFrame, nodes: DataFrame, size: int, threshold: int) -> DataFrame:
    sub = [F.col("subs")[i] for i in range(COLLECTIONS)]
    tables = list(combinations(range(COLLECTIONS), 2))
    keys = F.array(*(F.xxhash64(F.lit(COLLECTIONS * i + j), sub[i], sub[j]) for i, j in tables))
    placed = nodes.select("id", F.posexplode(keys).alias("table", "key"))
    buckets = placed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    crowded = materialize(placed.join(buckets, "key"), "minhash-buckets")
    sets = materialize(full_sets(docs, nodes.join(crowded.select("id").distinct(), "id", "left_semi"), size), "minhash-sets")

    hubs = crowded.filter("id <> hub").groupBy("id").agg(F.min("hub").alias("hub"))
    first = materialize(hubs.select(F.col("id").alias("a"), F.col("hub").alias("b")), "minhash-pairs")
    edges = materialize(verified(first, sets, threshold), "minhash-edges")
    component = connected_components(edges)

    others = crowded.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    second = materialize(_apart(others, component).join(first, ["a", "b"], "left_anti"), "minhash-pairs")
    edges = materialize(edges.unionByName(verified(second, sets, threshold)), "minhash-edges")
    component = connected_components(edges)

    third = _remaining(crowded, nodes, sets, component, threshold).join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti")
    third = materialize(third, "minhash-pairs")
    return materialize(edges.unionByName(verified(third, sets, threshold)), "minhash-edges")


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components; an id without links is a component of its own."""
    for side in ("a", "b"):
        own = component.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return pairs.filter("ca <> cb").select("a", "b")


def _remaining(crowded: DataFrame, nodes: DataFrame, sets: DataFrame, component: DataFrame, threshold: int) -> DataFrame:
    """Pairs that share a bucket of three sets or more, lie in different components and may be near.

    A pair is taken in the first bucket that it shares, which is told by its sub-hashes. The pairs of a bucket of two
    are compared already. Near sets have at most (100 - threshold) / (100 + threshold) of their sizes' sum in one of them
    alone, and so differ in at most so many parities. Shingles that one of these sets has alone are in no intersection: with m the others of n,
    the similarity asked for needs (100 + threshold) * least m >= threshold * (sum of n).
    """
    known = component.select("id", F.col("component"))
    members = crowded.filter("n > 2").join(known, "id", "left").select("key", "table", "id", "n", F.coalesce("component", "id").alias("c"))
    split = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
    members = materialize(members.join(split, "key"), "minhash-remaining")
    own = sets.join(members.select("id").distinct(), "id", "left_semi")
    alone = own.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.count("*").alias("sets"))
    alone = alone.filter("sets = 1").groupBy("id").agg(F.count("*").alias("alone"))
    facts = own.select("id", F.size("shingles").alias("size"), *_BITS).join(alone, "id", "left").join(nodes.select("id", "subs"), "id")
    facts = facts.withColumn("others", F.col("size") - F.coalesce("alone", F.lit(0))).drop("alone")
    able = facts.filter(100 * F.col("others") >= threshold * F.col("size"))  # else near to no other set at all
    rows = materialize(members.join(able, "id").withColumn("parts", F.ceil(F.col("n") / BUCKET_ROWS)), "minhash-remaining")
    # a large bucket's sets are dealt among parts, and each part meets copies of all of them in a task of its own
    x = rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts")).alias("x")
    y = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("y")
    differ = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in _BITS), F.lit(0))
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.id") > F.col("y.id")) & (F.col("x.c") != F.col("y.c"))
    near &= (100 + threshold) * F.least("x.others", "y.others") >= threshold * (F.col("x.size") + F.col("y.size"))
    agree = F.array(*(F.col("x.subs")[i] == F.col("y.subs")[i] for i in range(COLLECTIONS)))
    one = F.array_position(agree, True)
    two = one + F.array_position(F.slice(agree, one.cast("int") + 1, COLLECTIONS), True)
    table = F.element_at(F.array(*(F.lit(COLLECTIONS * i + j) for i, j in combinations(range(COLLECTIONS), 2))), F.col("x.table") + 1)
    at_first = table == COLLECTIONS * (one - 1) + (two - 1)
    near &= (100 + threshold) * differ <= (100 - threshold) * (F.col("x.size") + F.col("y.size"))
    return x.join(y, near & at_first).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def op3_minhash_tensored(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document: near_duplicates on shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4)


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents),
sized AS (SELECT doc_id, w, least(len(w), 4) AS k FROM words WHERE len(w) > 0),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM sized)),
counts AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN counts p ON p.doc_id = a JOIN counts q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE l.b > r.c)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN counts USING (doc_id) JOIN (SELECT id AS doc_id, min(c) AS component_id FROM reach GROUP BY id) USING (doc_id)
"""
