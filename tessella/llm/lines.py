"""Lines that many documents repeat: two Bloom filters pick suspects, and only suspects are shuffled and counted.

One filter has the keys seen once and one those seen twice or more. A task sends, for each segment of the bits, the places
that its documents' keys set, two bytes a place; a bit set by two keys' places is in the second filter. The segments are
written to the shared folder, where tasks read the second filter: a line with both of its bits there is a suspect. Suspects
alone are shuffled, by digest, to count documents exactly and to choose the one that keeps the line.

The bits follow the bytes of all texts, up to a bound. Beyond it the filter passes more lines as suspects, and so saves less
of the shuffle; what is counted stays exact at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import byte_slices, texts_of
from tessella.llm.picking import free_name, join_hot
from tessella.storage import materialize, shared_folder

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
BLANKS = b" \t\n\v\f\r"
#: Filter bits for each byte of text, and their bounds, as powers of two. A key has LEAST_CHARS bytes at least.
BITS_A_BYTE = 0.4
LEAST_BITS, MOST_BITS = 16, 30
SEGMENT = 16
#: Places that a task holds before it sends them.
HELD_PLACES = 4 << 20


def line_keys(text: str, least: int = LEAST_CHARS) -> list[bytes | None]:
    """The key of each line of a text: blanks stripped, A-Z lower-cased; None where it has fewer than `least` characters."""
    keys = [line.strip(BLANKS) for line in text.encode().lower().split(b"\n")]
    if text.isascii():
        return [k if len(k) >= least else None for k in keys]
    return [k if len(k) >= least and (len(k) >= 4 * least or len(k.decode()) >= least) else None for k in keys]


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two places of each hash, a row each."""
    mask = np.uint64((1 << bits) - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask]).astype(np.uint32)


def _place_rows(batches: Iterator[pa.RecordBatch], bits: int, least: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for piece in byte_slices(batches, "text"):
        for text in texts_of(piece):
            own = {xxhash.xxh3_64_intdigest(k) for k in line_keys(text, least) if k is not None}
            held.append(np.fromiter(own, np.uint64, len(own)))
            n += 2 * len(own)
        if n >= HELD_PLACES:
            yield from _segments(held, bits)
            held, n = [], 0
    yield from _segments(held, bits)


def _segments(held: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (segment, once, again): places within the segment that keys set, and those that more than one set."""
    places, counts = np.unique(_places(np.concatenate(held), bits) if held else np.zeros(0, np.uint32), return_counts=True)
    segments = np.unique(places >> np.uint32(SEGMENT))
    edges = np.append(segments, segments[-1:] + np.uint32(1)) << np.uint32(SEGMENT) if len(segments) else np.zeros(1, np.uint32)

    def cut(values: np.ndarray) -> pa.Array:
        ends = np.searchsorted(values, edges[:-1].astype(np.int64)).tolist() + [len(values)]
        offsets = pa.py_buffer((np.array(ends) * 2).astype(np.int32))
        return pa.BinaryArray.from_buffers(pa.binary(), len(segments), [None, offsets, pa.py_buffer(values.astype("<u2"))])

    columns = [pa.array(segments.astype(np.int32)), cut(places), cut(places[counts > 1])]
    yield pa.RecordBatch.from_arrays(columns, names=["segment", "once", "again"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order, many rows each: the second filter's bits of each segment."""
    now, once, twice = None, None, None
    for batch in batches:
        for segment, seen, again in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if segment != now:
                if now is not None:
                    yield _segment_row(now, twice)
                now, once, twice = segment, np.zeros(1 << SEGMENT, bool), np.zeros(1 << SEGMENT, bool)
            places = np.frombuffer(seen.as_buffer(), "<u2")
            twice[places[once[places]]] = True
            twice[np.frombuffer(again.as_buffer(), "<u2")] = True
            once[places] = True
    if now is not None:
        yield _segment_row(now, twice)


def _segment_row(segment: int, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "twice": [np.packbits(twice, bitorder="little").tobytes()]})


def repeat_filter(docs: DataFrame, least: int = LEAST_CHARS, most_bits: int = MOST_BITS) -> tuple[str, int]:
    """Write the filter of keys seen twice; its folder and its bits as a power of two.

    A key that two documents have, or that stands in two rows of one doc_id, is in it; one that one row has alone may be.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(LEAST_BITS, int(size * BITS_A_BYTE).bit_length()))
    rows = docs.select("text").mapInArrow(lambda b: _place_rows(b, bits, least), "segment int, once binary, again binary")
    merged = rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment int, twice binary")
    folder = shared_folder(docs.sparkSession, "line-filter")
    merged.write.parquet(folder)
    return folder, bits


@lru_cache(maxsize=1)
def _filter_bits(folder: str, bits: int) -> np.ndarray:
    """The second filter whole, 2**MOST_BITS bits at most; a worker reads it once."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    system, path = fs.FileSystem.from_uri(folder)
    size = 1 << (SEGMENT - 3)
    for batch in ds.dataset(path, filesystem=system, format="parquet").to_batches(batch_size=1024):
        for segment, twice in zip(batch.column("segment").to_pylist(), batch.column("twice"), strict=True):
            out[segment * size : (segment + 1) * size] = np.frombuffer(twice.as_buffer(), np.uint8)
    return out


_SUSPECTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("digest", pa.binary()), ("lines", pa.list_(pa.int32()))])


def _suspects(batches: Iterator[pa.RecordBatch], folder: str, bits: int, least: int) -> Iterator[pa.RecordBatch]:
    known = _filter_bits(folder, bits)
    for piece in byte_slices(batches, "text"):
        rows: list[tuple] = []
        for doc, sign, text in zip(piece.column("doc_id").to_pylist(), piece.column("text_hash").to_pylist(), texts_of(piece), strict=True):
            keys = line_keys(text, least)
            at = [i for i, k in enumerate(keys) if k is not None]
            hashes = np.array([xxhash.xxh3_64_intdigest(keys[i]) for i in at], np.uint64)
            places = _places(hashes, bits)
            hit = (known[places >> np.uint32(3)] >> (places & np.uint32(7)).astype(np.uint8) & 1).all(axis=0)
            lines: dict[bytes, list[int]] = {}
            for j in np.flatnonzero(hit).tolist():
                lines.setdefault(keys[at[j]], []).append(at[j])
            rows.extend((doc, sign, blake2b(k, digest_size=16).digest(), v) for k, v in lines.items())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUSPECTS, strict=True)], schema=_SUSPECTS)


def repeated_lines(docs: DataFrame, least: int = LEAST_CHARS, documents: int = LEAST_DOCUMENTS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, text_hash, lines): the lines, from 0, that each document loses; a row for each that loses any.

    A key of `least` characters that `documents` different doc_ids have loses its lines, except in the largest of them. Null
    doc_ids count as one document, which never keeps a line. Rows of one doc_id are one document, and all of them keep it.
    """
    folder, bits = repeat_filter(docs, least, most_bits)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = keyed.mapInArrow(lambda b: _suspects(b, folder, bits, least), "doc_id long, text_hash long, digest binary, lines array<int>")
    suspects = materialize(found, "line-suspects")
    holders = suspects.select("digest", "doc_id").groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    counts = holders.groupBy("digest").agg(F.count("*").alias("holders"), F.max("doc_id").alias("keeper"), F.sum("rows").alias("rows"))
    confirmed = materialize(counts.filter(F.col("holders") >= documents).select("digest", "keeper", "rows"), "line-repeats")
    lost = join_hot(suspects, confirmed, ["digest"], "rows").filter("NOT doc_id <=> keeper")
    # a set, as rows that repeat a document whole send the same lines
    return lost.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("lines")).alias("lines"))


def _without(batches: Iterator[pa.RecordBatch], text: str, lines: str) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, text):
        kept = []
        for value, lost in zip(batch.column(text).to_pylist(), batch.column(lines), strict=True):
            if lost.is_valid:
                stays = value.split("\n")
                gone = np.zeros(len(stays), bool)
                gone[lost.values.to_numpy()] = True
                value = "\n".join([s for s, g in zip(stays, gone.tolist(), strict=True) if not g])
            kept.append(value)
        yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(kept, pa.string()))


def drop_repeated_lines(docs: DataFrame, least: int = LEAST_CHARS, documents: int = LEAST_DOCUMENTS, most_bits: int = MOST_BITS) -> DataFrame:
    """`docs` without the lines that repeated_lines names, n_lines and n_dropped appended (or the names with underscores).

    The lines that stay are joined by line feeds. A null or empty text is one empty line and stays as it is; equal rows each
    have their row; no rows give none. Columns of docs keep their names and values.
    """
    lost = repeated_lines(docs, least, documents, most_bits)
    sign, lines, n_lines, n_dropped, doc = (free_name(docs, n) for n in ("text_hash", "lines", "n_lines", "n_dropped", "lost_doc_id"))
    lost = lost.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(sign), F.col("lines").alias(lines))
    keyed = docs.withColumn(sign, F.xxhash64("text"))
    same = F.col(doc).eqNullSafe(keyed["doc_id"].cast("long")) & (lost[sign] == keyed[sign])
    both = keyed.join(lost, same, "left").drop(lost[sign]).drop(doc)
    count = (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    both = both.select(*docs.columns, lines, F.coalesce(count, F.lit(1).cast("long")).alias(n_lines), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_dropped))
    return both.mapInArrow(lambda b: _without(b, "text", lines), both.schema).select(*docs.columns, n_lines, n_dropped)


def op13_bloom_lines(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document, without the lines that five documents repeat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


OP13_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
  SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split)),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT r, keyed.doc_id, i, line, repeated.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM keeper AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
