"""Removal of repeated passages: suffix arrays of shards that hold every copy of a passage.

1. Winnowing: the least hash of the shorter strings within any MATCH bytes is their anchor, so equal strings of MATCH bytes
   share it. Only strings whose anchor occurs again can repeat.
2. Runs of such strings go to shards by the anchor. Equal pieces are one piece with a number of copies, covered whole.
3. A shard's suffix array is induced. Strings that start more than once stand together in it: their permuted common
   prefixes reach the match. They are told apart from the same place seen through two anchors by document and offset.
An anchor whose pieces exceed a shard is split by anchors of longer strings, up to MATCH bytes, where all pieces are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import byte_slices
from tessella.llm.picking import BROADCAST_KEYS, join_hot
from tessella.llm.shingles import scramble
from tessella.llm.suffixes import hashes, permuted_prefixes, prefix_sums, suffix_array
from tessella.storage import materialize

MATCH = 400
#: Lengths of anchors as shares of the match, from the first to the last split.
LADDER = (0.5, 0.75, 0.9, 0.97, 1.0)
#: Anchors share shards of about so many bytes; one whose pieces take over a sixteenth of it has a shard of its own, so
#: that no shard is much larger than this or than HOT_BYTES.
SHARD_BYTES = 1 << 20
#: Pieces of one anchor of more bytes are split by longer anchors.
HOT_BYTES = 2 << 20
SLICE_BYTES = 2 << 20
#: Starts of strings that are hashed at once, so that a long text takes no more memory than a stride and its anchors.
STRIDE = 1 << 20
_SEPARATOR = 256
_LOWEST = -(1 << 63)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every run of `width` values: the best of a block's end and the next block's start."""
    n = len(values) - width + 1
    fill = np.uint64(np.iinfo(np.uint64).max if pick is np.minimum else 0)
    blocks = np.concatenate([values, np.full(-len(values) % width, fill, np.uint64)]).reshape(-1, width)
    up_to = pick.accumulate(blocks, axis=1).ravel()
    onward = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(onward[:n], up_to[width - 1 : width - 1 + n])


def pieces_of(raw: np.ndarray, size: int, match: int) -> tuple[np.ndarray, ...]:
    """(key, start, stop, times) of the runs of `match`-byte strings that have the same anchor, the least hash of their
    `size`-byte strings; times counts the places of that anchor in `raw`, which has at least `match` bytes.
    """
    width = match - size + 1
    last = len(raw) - match + 1
    edge = np.zeros(width - 1, np.uint64)
    keys, heads, anchors, before = [], [], [], None
    for start in range(0, last, STRIDE):
        stop = min(last, start + STRIDE)
        low = max(0, start - width + 1)  # strings of the last stride that hold this one's first anchors
        part = raw[low : stop + match - 1]
        own = scramble(hashes(prefix_sums(part), np.arange(len(part) - size + 1), size))
        least = _slide(own, width, np.minimum)
        mine = least[start - low :]
        fresh = np.flatnonzero(np.concatenate([[before is None or mine[0] != before], mine[1:] != mine[:-1]]))
        heads.append(fresh + start)
        keys.append(mine[fresh])
        before = mine[-1]
        anchored = _slide(np.concatenate([edge, least, edge]), width, np.maximum) == own
        here = slice(start - low, None if stop == last else stop - low)
        anchors.append(own[here][anchored[here]])
    keys, heads = np.concatenate(keys), np.concatenate(heads)
    tails = np.concatenate([heads[1:], [last]]) - 1
    names, counts = np.unique(np.concatenate(anchors), return_counts=True)
    return keys.view(np.int64), heads, tails + match, counts[np.searchsorted(names, keys)]


def _anchored(batches: Iterator[pa.RecordBatch], size: int, match: int) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", SLICE_BYTES):
        found, rows = [], []
        for i, value in enumerate(batch.column("text").cast(pa.binary())):
            raw = np.frombuffer(value.as_buffer(), np.uint8)
            found.append(pieces_of(raw, size, match))
            rows.append(np.full(len(found[-1][0]), i))
        if found:
            origin = pa.array(np.concatenate(rows))
            columns = [batch.column(c).take(origin) for c in ("id", "d")]
            columns += [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "d", "key", "start", "stop", "times"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("d", pa.int64()), ("start", pa.int64()), ("piece", pa.binary())])
    for batch in byte_slices(batches, "text", SLICE_BYTES // 4):
        out: list[list] = [[], [], [], [], []]
        for text, doc, d, places in zip(batch.column("text").cast(pa.binary()), *(batch.column(c).to_pylist() for c in ("id", "d", "places")), strict=True):
            view = memoryview(text.as_buffer())
            for p in places:
                for column, value in zip(out, (p["key"], doc, d, p["start"], bytes(view[p["start"] : p["stop"]])), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def _split(batches: Iterator[pa.RecordBatch], size: int, match: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a hot anchor by anchors of `size` bytes, keyed anew."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("d", pa.int64()), ("start", pa.int64()), ("piece", pa.binary()), ("copies", pa.int64())])
    for batch in batches:
        out: list[list] = [[] for _ in schema]
        for piece, *fields in zip(batch.column("piece"), *(batch.column(c).to_pylist() for c in ("id", "d", "start", "copies")), strict=True):
            view = memoryview(piece.as_buffer())
            doc, d, start, copies = fields
            for key, a, b, _ in zip(*(x.tolist() for x in pieces_of(np.frombuffer(view, np.uint8), size, match)), strict=True):
                for column, value in zip(out, (key, doc, d, start + a, bytes(view[a:b]), copies), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def repeated_in_shard(shard: pd.DataFrame, match: int) -> pd.DataFrame:
    """(id, d, start, stop): in pieces with one copy, the bytes of strings of `match` bytes that also start elsewhere.

    Pieces with more copies are covered anyway and take part as others' matches.
    """
    shard = shard.sort_values(["key", "id", "d", "start"], ignore_index=True)
    raws = shard["piece"].tolist()
    sizes = np.array([len(r) for r in raws])
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    text = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8).astype(np.int16)
    text[stops] = _SEPARATOR
    order = suffix_array(text)
    joined = permuted_prefixes(text, order)[order[1:]] >= match
    piece = np.repeat(np.arange(len(raws), dtype=np.int32), sizes + 1)
    own = piece[order]
    inside = order + match <= stops[own]
    joined &= inside[1:] & inside[:-1]
    heads = np.flatnonzero(np.r_[True, ~joined])
    doc = shard.groupby(["id", "d"], sort=False).ngroup().to_numpy()
    place = ((doc.astype(np.int64) << 40) + shard["start"].to_numpy() - starts)[own]
    place += order
    several = (shard["copies"].to_numpy() > 1)[own]
    again = np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)
    again |= np.logical_or.reduceat(several, heads)
    del place, own
    runs = np.repeat(again, np.diff(np.r_[heads, len(order)]))
    at = np.sort(order[runs & inside & ~several])
    if not len(at):
        return pd.DataFrame({"id": [], "d": [], "start": [], "stop": []}).astype("int64")
    at = at.astype(np.int64)
    fresh = np.r_[True, (at[1:] - at[:-1] > match) | (piece[at[1:]] != piece[at[:-1]])]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(at)] - 1
    own = piece[at[first]]
    offset = shard["start"].to_numpy()[own] - starts[own]
    return pd.DataFrame({"id": shard["id"].to_numpy()[own], "d": shard["d"].to_numpy()[own], "start": at[first] + offset, "stop": at[last] + match + offset})


def _picked(texts: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of `texts` whose (id, d) is among the distinct ones of `ids`, or is not."""
    small = ids.count() <= BROADCAST_KEYS
    return texts.join(F.broadcast(ids) if small else ids, ["id", "d"], how)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, id, d, text: a document is known by its doc_id and the hash of its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(_LOWEST)).alias("id"), F.xxhash64("text").alias("d"), "text"
    )


def repeated_spans(docs: DataFrame, match: int = MATCH, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, d) of documents whose whole text of at least `match` bytes stands in another row too; and
    (id, d, spans) of the other documents with repeated bytes, spans in any order and overlapping.
    """
    sizes = [max(2, round(match * share)) for share in LADDER]
    texts = keyed_texts(docs).filter(F.octet_length("text") >= match)
    facts = materialize(texts.select("id", "d", F.sha1(F.col("text").cast("binary")).alias("sha"), F.octet_length("text").alias("n")), "repeats-texts")
    several = facts.groupBy("sha", "n").agg(F.min(F.struct("id", "d")).alias("kept"), F.count("*").alias("rows")).filter("rows > 1")
    several = materialize(several, "repeats-texts")
    copied = materialize(join_hot(facts, several, ["sha", "n"], "rows").select("id", "d", (F.struct("id", "d") == F.col("kept")).alias("first")).distinct(), "repeats-copies")
    whole, later = copied.select("id", "d"), copied.filter("NOT first").select("id", "d")

    found = texts.select("id", "d", "text").mapInArrow(
        lambda batches: _anchored(batches, sizes[0], match), "id long, d long, key long, start long, stop long, times long"
    )
    found = materialize(_picked(found, later, "left_anti").distinct(), "repeats-anchors")
    again = found.groupBy("key").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).filter("times > 1").select("key", "rows")
    places = join_hot(found, materialize(again, "repeats-again"), ["key"], "rows").groupBy("id", "d").agg(F.collect_list(F.struct("key", "start", "stop")).alias("places"))
    places = materialize(places, "repeats-places")
    held = _picked(texts.select("id", "d", "text"), places.select("id", "d")).dropDuplicates(["id", "d"])
    cut = materialize(held.join(places, ["id", "d"]).mapInArrow(_cut, "key long, id long, d long, start long, piece binary"), "repeats-pieces")

    pieces, spans = _collapsed(cut.withColumn("copies", F.lit(1).cast("long")))
    for level, size in enumerate([*sizes[1:], None]):
        sums = pieces.groupBy("key").agg(F.sum(F.octet_length("piece")).alias("bytes"), F.count("*").alias("n"), F.max("copies").alias("most"))
        sums = sums.filter("n > 1 OR most = 1")
        hot = materialize(sums.filter(F.col("bytes") > hot_bytes).select("key"), "repeats-hot") if size else None
        more = hot is not None and not hot.isEmpty()
        usual = sums.filter(F.col("bytes") <= hot_bytes) if more else sums
        spans = spans.unionByName(_sharded(pieces.join(usual.select("key", "bytes"), "key"), match, shard_bytes))
        if not more:
            break
        part = pieces.join(hot, "key").mapInArrow(
            lambda batches, size=size: _split(batches, size, match), "key long, id long, d long, start long, piece binary, copies long"
        )
        pieces, equal = _collapsed(materialize(part.distinct(), f"repeats-split-{level}"))
        spans = spans.unionByName(equal)
    own = materialize(spans, "repeats-spans").groupBy("id", "d").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return whole, materialize(_picked(own, whole, "left_anti"), "repeats-covers")


def _collapsed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pieces of each key, with one real place and their copies; and all places of those with several.

    A row of several copies stands for them at one of their places; all were given out when it was made, so none is here.
    """
    least = rows.groupBy("key", "piece").agg(F.min(F.struct("id", "d", "start")).alias("place"), F.sum("copies").alias("copies"))
    pieces = materialize(least.select("key", "piece", "place.*", "copies"), "repeats-distinct")
    sign = [F.xxhash64("piece").alias("g"), F.hash("piece").alias("h")]
    several = materialize(pieces.filter("copies > 1").select("key", *sign, "copies"), "repeats-equal")
    lean = rows.filter("copies = 1").select("key", *sign, "id", "d", "start", (F.col("start") + F.octet_length("piece")).alias("stop"))
    return pieces, join_hot(lean, several, ["key", "g", "h"], "copies").select("id", "d", "start", "stop")


def _sharded(pieces: DataFrame, match: int, shard_bytes: int) -> DataFrame:
    pieces = materialize(pieces, "repeats-sharded")
    total = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    shards = max(1, int(np.ceil(total / shard_bytes)))
    shard = F.when(F.col("bytes") > shard_bytes // 16, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards)))
    dealt = pieces.withColumn("shard", shard).drop("bytes").repartition(shards, "shard")
    found = dealt.groupBy("shard").applyInPandas(lambda shard: repeated_in_shard(shard, match), "id long, d long, start long, stop long")
    return materialize(found, "repeats-found")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", SLICE_BYTES):
        rows = []
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            runs: list[list[int]] = []
            for start, stop in sorted((s["start"], s["stop"]) for s in spans):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], stop)
                else:
                    runs.append([start, stop])
            edges = [0, *(e for run in runs for e in run), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc, len(text), len(text) - len(kept), len(runs), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, match: int = MATCH, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that remain.

    A byte goes if a string of `match` bytes that covers it also starts anywhere else; all copies go. Texts are UTF-8
    bytes, null texts empty ones. Repeated rows are copies of each other; rows with one doc_id and different texts are
    documents of their own. Other columns are left out.
    """
    whole, covers = repeated_spans(docs, match, shard_bytes, hot_bytes)
    texts = keyed_texts(docs)
    touched = whole.unionByName(covers.select("id", "d"))
    clean = _picked(texts, touched, "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept")
    )
    gone = _picked(texts, whole).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept")
    )
    held = _picked(texts, covers.select("id", "d")).join(covers, ["id", "d"]).select("doc_id", "text", "spans")
    return clean.unionByName(gone).unionByName(held.mapInArrow(_removed, _OUT))


def op5_induced_suffixes(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document: remove_repeats with its defaults.

    A null text is an empty one; rows without a repeat of 400 bytes keep all their bytes.
    """
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
