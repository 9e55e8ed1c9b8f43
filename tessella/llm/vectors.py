"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits by random directions at the median of a sample; vectors near a split go down both sides. The upper levels are
fitted on a sample of all vectors. Leaves that hold more than MOST are split again, on samples of their own, until none does
that can be split, so that a leaf's size does not grow with the table. Vectors are compared within leaves only. A pair that meets in several leaves is counted in the first of them, which each leaf can tell by
itself, so a leaf gives counts and a spanning forest of its links and never all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.storage import materialize

THRESHOLD = 0.95
#: Trees are fitted on at most so many vectors, those with the smallest hash of vec_id; every vector is indexed.
SAMPLE = 20_000
TREES = 6
#: Half the width of the band around a split that goes down both sides, for unit vectors.
SPILL = 0.02
LEAF = 400
#: Leaves of more vectors are split again, on at most so many of their vectors and by so many levels at a time.
MOST, SPLIT_SAMPLE, SPLIT_DEPTH, SPLIT_ROUNDS = 2048, 2048, 8, 3
#: A node is no more split where its split would send more than this share of its sample down both sides.
OVERLAP = 0.5
#: Up to so many splits are broadcast to the rows of their leaves; beyond it rows and splits are shuffled.
BROADCAST_SPLITS = 10_000
#: Leaves of more vectors are compared block by block, every pair of blocks in a task of its own.
BLOCK = 1024
SEED = 7
#: Trees from this number on are those of vectors that have another length than the most.
OTHERS = 1000


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order: the children of i are 2 i + 1 and 2 i + 2."""

    directions: np.ndarray
    thresholds: np.ndarray
    depth: int

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors; a row is in several leaves where it lies near a split."""
        rows, nodes = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", unit[rows], self.directions[nodes]) - self.thresholds[nodes]
            left, right = ~(side > SPILL), side >= -SPILL  # without a threshold all go left
            rows, nodes = np.r_[rows[left], rows[right]], np.r_[2 * nodes[left] + 1, 2 * nodes[right] + 2]
        return rows, nodes


def _directions(depth: int, dimension: int, seed) -> np.ndarray:
    directions = np.random.default_rng(seed).standard_normal((max((1 << depth) - 1, 1), dimension))
    return directions / np.linalg.norm(directions, axis=1, keepdims=True)


def fit_tree(sample: np.ndarray, depth: int, seed) -> Tree:
    """A tree whose splits are at the sample's medians; a node that cannot be split has NaN for a threshold."""
    directions = _directions(depth, sample.shape[1], seed)
    thresholds, held = np.full(len(directions), np.nan), {0: sample}
    for node in range((1 << depth) - 1):
        part = held.pop(node)
        side = part @ directions[node]
        if len(part) > 1:
            middle = np.median(side)
            if (np.abs(side - middle) <= SPILL).mean() <= OVERLAP:
                thresholds[node] = middle
        left = ~(side > thresholds[node])
        held[2 * node + 1], held[2 * node + 2] = part[left], part[~left]
    return Tree(directions, thresholds, depth)


def _numbers(value) -> np.ndarray | None:
    """A vector that has a direction, else None."""
    if value is None or not len(value):
        return None
    numbers = np.array([np.nan if x is None else x for x in value], dtype=np.float64)
    return numbers if np.isfinite(numbers).all() and np.linalg.norm(numbers) > 0 else None


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [None if (v := _numbers(x)) is None else v.tobytes() for x in batch.column("embedding").to_pylist()]
        digests = [None if v is None else hashlib.sha1(v).hexdigest() for v in raw]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(digests, pa.string()), pa.array(raw, pa.binary())], names=["vec_id", "digest", "raw"]
        )


def _unit(raw: list[bytes]) -> np.ndarray:
    vectors = np.array([np.frombuffer(v, np.float64) for v in raw])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _indexed(batches: Iterator[pa.RecordBatch], trees: list[Tree], dimension: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = batch.column("raw").to_pylist()
        same = np.flatnonzero([len(v) == 8 * dimension for v in raws])
        other = np.flatnonzero([len(v) != 8 * dimension for v in raws])
        places: list[list[tuple[int, int]]] = [[] for _ in raws]
        if len(same):
            unit = _unit([raws[i] for i in same])
            for number, tree in enumerate(trees):
                for row, leaf in zip(*(x.tolist() for x in tree.leaves(unit)), strict=True):
                    places[same[row]].append((number, leaf))
        for i in other:  # vectors of another length have trees of their own, which begin as one leaf
            places[i] += [(OTHERS + len(trees) * (len(raws[i]) // 8) + t, 0) for t in range(len(trees))]
        origin = np.repeat(np.arange(len(raws)), [len(p) for p in places])
        codes = [[(t << 40) + leaf for t, leaf in p] for p in places]
        flat = [x for p in places for x in p]
        columns = [batch.column(c).take(pa.array(origin)) for c in ("id", "copies", "raw")]
        columns += [pa.array([t for t, _ in flat], pa.int32()), pa.array([leaf for _, leaf in flat], pa.int64())]
        columns.append(pa.array([codes[i] for i in origin], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=["id", "copies", "raw", "tree", "leaf", "places"])


def _fitted_split(group: pd.DataFrame, leaf_size: int) -> pd.DataFrame:
    """The thresholds of a leaf's split, from a sample of its vectors; none where it cannot be split."""
    tree, leaf, n = (int(group[c].iloc[0]) for c in ("tree", "leaf", "n"))
    depth = min(SPLIT_DEPTH, max(1, int(np.ceil(np.log2(n / leaf_size)))))
    fitted = fit_tree(_unit(group["raw"].tolist()), depth, [SEED, tree, leaf])
    if np.isnan(fitted.thresholds[0]):
        return pd.DataFrame({"tree": [], "leaf": [], "thresholds": []}).astype({"tree": "int32", "leaf": "int64", "thresholds": object})
    return pd.DataFrame({"tree": [np.int32(tree)], "leaf": [leaf], "thresholds": [fitted.thresholds.tobytes()]})


def _resettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of leaves that are split, each in its new leaves; rows come sorted by leaf."""
    for batch in batches:
        trees, leaves = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "leaf"))
        heads = np.flatnonzero(np.r_[True, (trees[1:] != trees[:-1]) | (leaves[1:] != leaves[:-1])]) if len(trees) else np.zeros(0, int)
        origin, fresh = [], []
        for a, b in zip(heads, np.r_[heads[1:], len(trees)], strict=True):
            thresholds = np.frombuffer(batch.column("thresholds")[a].as_py())
            depth, unit = len(thresholds).bit_length(), _unit(batch.column("raw").slice(a, b - a).to_pylist())
            tree = Tree(_directions(depth, unit.shape[1], [SEED, int(trees[a]), int(leaves[a])]), thresholds, depth)
            rows, nodes = tree.leaves(unit)
            origin.append(a + rows)
            fresh.append((int(leaves[a]) << SPLIT_DEPTH + 1) + nodes)
        if origin:
            same = pa.array(np.concatenate(origin))
            columns = [batch.column(c).take(same) for c in ("id", "copies", "raw", "tree")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(fresh), pa.int64())], names=["id", "copies", "raw", "tree", "leaf"])


def split_large_leaves(placed: DataFrame) -> DataFrame:
    """`placed` with its leaves of more than MOST vectors split again, and the places of vectors as they then are."""
    before, leaf_size = placed, LEAF
    for _ in range(SPLIT_ROUNDS):
        large = placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > MOST)
        large = materialize(large, "vectors-large")
        many = large.count()
        if not many:
            break
        hint = F.broadcast if many <= BROADCAST_SPLITS else (lambda frame: frame)
        drawn = placed.join(hint(large), ["tree", "leaf"]).filter(F.pmod(F.xxhash64("id", "tree", "leaf"), "n") < SPLIT_SAMPLE)
        splits = drawn.select("tree", "leaf", "n", "raw").groupBy("tree", "leaf").applyInPandas(
            lambda group: _fitted_split(group, leaf_size), "tree int, leaf long, thresholds binary"
        )
        splits = materialize(splits, "vectors-splits")
        if splits.isEmpty():
            break
        rows = placed.select("id", "copies", "raw", "tree", "leaf")
        moved = rows.join(hint(splits), ["tree", "leaf"]).sortWithinPartitions("tree", "leaf")
        moved = moved.mapInArrow(_resettled, "id long, copies long, raw binary, tree int, leaf long")
        stay = rows.join(hint(splits.select("tree", "leaf")), ["tree", "leaf"], "left_anti")
        placed = materialize(stay.select(moved.columns).unionByName(moved), "vectors-placed")
    if placed is before:
        return placed
    code = F.shiftleft(F.col("tree").cast("long"), 40) + F.col("leaf")
    return placed.join(placed.groupBy("id").agg(F.collect_list(code).alias("places")), "id")


def _met_before(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, place: int) -> np.ndarray:
    """Which of the pairs share a leaf whose code is below `place`: one of an earlier tree, or an earlier one of this."""
    involved = np.unique(np.r_[a, b])
    codes = [np.asarray(rows[i])[np.asarray(rows[i]) < place] for i in involved]
    if not any(map(len, codes)):
        return np.zeros(len(a), bool)
    number, names = pd.factorize(np.concatenate(codes))
    hot = np.zeros((len(involved), len(names)), np.float32)
    hot[np.repeat(np.arange(len(involved)), list(map(len, codes))), number] = 1
    x, y = np.searchsorted(involved, a), np.searchsorted(involved, b)
    if len(a) > len(involved) * 8:
        return (hot @ hot.T)[x, y] > 0
    return np.concatenate([(hot[x[i : i + 4096]] * hot[y[i : i + 4096]]).any(axis=1) for i in range(0, len(a), 4096)])


def _forest_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row linked to each row, through any number of links."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def compare_leaf(group: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """The links of one pair of blocks of a leaf: per vector, how many others it links with that no earlier leaf has
    shown, and an edge to the smallest id it is connected with here.
    """
    group = group.sort_values("id", ignore_index=True)
    unit = _unit(group["raw"].tolist())
    blocks, pair = group["block"].to_numpy(), (int(group["i"].iloc[0]), int(group["j"].iloc[0]))
    found_a, found_b = [], []
    for start in range(0, len(group), 512):
        near = unit[start : start + 512] @ unit.T >= threshold
        a, b = np.nonzero(near)
        a += start
        wanted = a < b
        if pair[0] != pair[1]:
            wanted &= blocks[a] != blocks[b]
        found_a.append(a[wanted])
        found_b.append(b[wanted])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if not len(a):
        return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
    place = (int(group["tree"].iloc[0]) << 40) + int(group["leaf"].iloc[0])
    new = ~_met_before(group["places"].tolist(), a, b, place)
    a, b = a[new], b[new]
    copies, ids = group["copies"].to_numpy(), group["id"].to_numpy()
    links = np.bincount(a, copies[b], len(group)) + np.bincount(b, copies[a], len(group))
    root = _forest_of(a, b, len(group))
    linked = links > 0
    return pd.DataFrame({"id": ids[linked], "links": links[linked].astype("int64"), "root": ids[root[linked]]})


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id and kept.

    Equal vectors are one node with a number of copies. Vectors that are null, empty or zero, or hold null or non-finite
    numbers link with nothing, and so do vectors of different lengths with each other. Rows that repeat a vec_id count as
    vectors of their own; a null vec_id links with nothing, its component is null and it is kept.
    """
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    packed = materialize(keyed.mapInArrow(_packed, "vec_id long, digest string, raw binary"), "vectors-packed")
    valid = packed.filter("digest IS NOT NULL AND vec_id IS NOT NULL")
    nodes = valid.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    nodes = materialize(nodes, "vectors-nodes")
    lengths = nodes.groupBy(F.octet_length("raw").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    if lengths is None:
        return packed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    size, count = lengths["bytes"], lengths["count"]
    share = int(min(1.0, 1.5 * sample / count) * (1 << 30))  # thinned where they stand, so that tasks send few in all
    able = nodes.filter((F.octet_length("raw") == size) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share))
    drawn = able.orderBy(F.xxhash64("id"), "id").limit(sample).select("raw").collect()
    unit = _unit([r["raw"] for r in drawn])
    depth = min(max(1, int(np.ceil(np.log2(count / LEAF)))), max(0, int(np.log2(len(unit) / 8))))
    forest = [fit_tree(unit, depth, seed + t) for t in range(trees)]
    shared = vectors.sparkSession.sparkContext.broadcast(forest)  # its size is bounded by the sample's
    placed = nodes.select("id", "copies", "raw").mapInArrow(
        lambda batches: _indexed(batches, shared.value, size // 8),
        "id long, copies long, raw binary, tree int, leaf long, places array<long>",
    )
    placed = split_large_leaves(materialize(placed, "vectors-placed"))
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = dealt.select("*", F.explode(others).alias("other"))
    dealt = dealt.select("id", "copies", "raw", "places", "tree", "leaf", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    links = dealt.groupBy("tree", "leaf", "i", "j").applyInPandas(
        lambda group: compare_leaf(group, threshold), "id long, links long, root long"
    )
    links = materialize(links, "vectors-links")
    components = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    classes = nodes.select("digest", "id", "copies").join(counts, "id", "left").join(components, "id", "left")
    classes = classes.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    rows = packed.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op7_projection_forest(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector: near_vectors with its defaults."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE l.b > r.c),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN counts USING (vec_id) JOIN (SELECT id AS vec_id, min(c) AS component_id FROM reach GROUP BY id) USING (vec_id)
"""
