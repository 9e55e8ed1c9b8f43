"""Token-id files: length-delimited records with masked checksums, and an offset index for shuffled reads.

A record is its payload's length (unsigned 64 bits), the masked CRC-32 of those eight bytes, the payload, and the
payload's masked CRC-32, all little-endian. A payload is a flag (1 where doc_id is not null), the doc_id, the bytes per
id, and the ids. The index beside a data file has for each record its doc_id, byte offset and number of ids.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.batches import byte_slices, texts_of
from tessella.llm.files import open_folder, read_exactly, whole_file
from tessella.storage import materialize, shared_folder

END_ID = 2
LENGTH, HEAD, INDEX = struct.Struct("<QI"), struct.Struct("<BqB"), struct.Struct("<qQQ")
#: Distinct words whose ids a worker remembers; beyond it it forgets them all and goes on.
MEMO_WORDS = 800_000
# Letters, numbers and white space of the split pattern below U+0250, and the ranges above it that hold only marks.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
_WORDS = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+| ?[{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _byte_letters() -> dict[int, str]:
    """The visible character that byte-level BPE writes for each byte: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Encodes texts word by word: the tokenizers library's BPE sees each distinct word once and is remembered.

    Byte-level BPE merges only within the words of its split pattern, so a text's ids are its words' ids in order.
    Texts with characters of which the split depends on Unicode tables, and those that hold an added token's content,
    which the library finds before it splits, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_OTHER.pattern, *added]))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.memo = _Memo(self.tokenizer.model.tokenize, "H" if self.width == 2 else "I")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian integers of `width` bytes."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        ids_of = self.memo.__getitem__
        return [self._whole(t) if self.whole.search(t) else b"".join(map(ids_of, _WORDS.findall(t))) for t in texts]


class _Memo(dict):
    """Word to ids, merged by the library where missing."""

    def __init__(self, merge, code: str) -> None:
        super().__init__()
        self.merge, self.code = merge, code
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def __missing__(self, word: str) -> bytes:
        ids = array(self.code, [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.letters))])
        if sys.byteorder == "big":
            ids.byteswap()
        self[word] = raw = ids.tobytes()
        return raw


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of every text in ascending doc_id order; one row per file: part, path, index, n_docs, n_tokens.

    Texts are dealt by ranges of doc_id and, within one that many rows have, of the text's hash, so files follow each other in
    that order, and sorted within them. Null texts
    are empty documents, which hold the end id alone; null doc_ids come first; repeated rows are written each, in any
    order among themselves. No rows: no files.
    """
    ordered = docs.select("doc_id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")

    files = ordered.mapInArrow(
        lambda batches: _write_part(batches, tokenizer_path, folder, end_id),
        "part int, path string, index string, n_docs long, n_tokens long",
    )
    return materialize(files, "token-files")


def _write_part(batches: Iterator[pa.RecordBatch], tokenizer_path: str, folder: str, end_id: int) -> Iterator[pa.RecordBatch]:
    pieces = byte_slices(batches, "text")
    first = next(pieces, None)
    if first is None:
        return
    system, root = open_folder(folder)
    part = TaskContext.get().partitionId()
    path, index = f"{root}/part-{part:06d}.records", f"{root}/part-{part:06d}.index"
    encoder = WordEncoder(tokenizer_path)
    end = np.array([end_id], dtype=encoder.kind).tobytes()
    n_docs = n_tokens = offset = 0
    with whole_file(system, path) as data, whole_file(system, index) as places:
        for piece in chain([first], pieces):
            for doc, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(texts_of(piece)), strict=True):
                payload = HEAD.pack(doc is not None, doc or 0, encoder.width) + ids + end
                size = struct.pack("<Q", len(payload))
                record = size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))
                count = (len(payload) - HEAD.size) // encoder.width
                data.write(record)
                places.write(INDEX.pack(doc or 0, offset, count))
                offset += len(record)
                n_docs, n_tokens = n_docs + 1, n_tokens + count
    yield pa.RecordBatch.from_pydict(
        {"part": [part], "path": [path], "index": [index], "n_docs": [n_docs], "n_tokens": [n_tokens]}, schema=_FILES
    )


_FILES = pa.schema([("part", pa.int32()), ("path", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32())])


def read_payload(stream) -> tuple[int | None, np.ndarray]:
    """The next record's doc_id and ids, both checksums verified."""
    head = read_exactly(stream, LENGTH.size)
    size, check = LENGTH.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length does not match its checksum")
    payload = read_exactly(stream, size)
    if masked(payload) != struct.unpack("<I", read_exactly(stream, 4))[0]:
        raise ValueError("a record's payload does not match its checksum")
    known, doc, width = HEAD.unpack_from(payload)
    return (doc if known else None), np.frombuffer(payload, f"<u{width}", offset=HEAD.size)


def read_records(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """The records of written files, a task per file: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    start counts the ids of all documents before, over the files in their order.
    """
    parts = files.select("part", "path", "n_docs", "n_tokens")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row per file
    spread = parts.coalesce(1).repartition(max(1, files.count()))  # dealt in turn from one list of names
    kind = "doc_id long, local long, n_tokens long, ids_crc32 long, part int" + (", ids array<int>" if with_ids else "")
    rows = spread.mapInArrow(lambda batches: _read_parts(batches, folder, with_ids), kind).join(F.broadcast(offsets), "part")
    return rows.select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )


def _read_parts(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    schema = _ROWS.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _ROWS
    system, _ = open_folder(folder)
    for batch in batches:
        for part, path, n_docs in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "n_docs")), strict=True):
            local, held, rows = 0, 0, []
            with system.open_input_stream(path, buffer_size=1 << 20) as stream:
                for _ in range(n_docs):
                    doc, ids = read_payload(stream)
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((doc, local, len(ids), crc, part) + ((ids.astype(np.int32),) if with_ids else ()))
                    local, held = local + len(ids), held + (len(ids) if with_ids else 1)
                    if held >= (1 << 20 if with_ids else 20_000):
                        yield _batch(rows, schema)
                        held, rows = 0, []
            if rows:
                yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def shuffled_places(system, index_path: str, seed: int) -> list[tuple[int, int, int]]:
    """A data file's (doc_id, offset, n_tokens) in a random order fixed by the seed, for reads that seek."""
    with system.open_input_stream(index_path) as stream:
        places = list(INDEX.iter_unpack(stream.read()))
    return [places[i] for i in np.random.default_rng(seed).permutation(len(places))]


def op2_token_records(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that were written; a null text has the end
    id alone.
    """
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_records(files, folder)
