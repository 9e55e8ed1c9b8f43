"""Web archives by way of a chunked record table.

A page's payload becomes rows of (record, chunk_no, chunk) of bounded size, each with the SHA-1 of the payload up to it, so
no later step holds a whole record. A record of several chunks is a segmented WARC record: a first segment and continuation
records. Each WARC record is a gzip member of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import byte_slices
from tessella.llm.files import open_folder, whole_file
from tessella.storage import materialize, shared_folder

CHUNK_BYTES = 1 << 20
#: Chunks leave a task in batches of about so many bytes, however long their payload is.
BATCH_BYTES = 4 << 20
#: Payloads of at least so many bytes become revisits of an equal one.
REVISIT_BYTES = 1000
#: Copies of the table of equal payloads, so that a payload that many pages share is joined in so many tasks.
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FIELDS = ("page_id", "url", "sha1", "n_bytes", "refers_to")


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages whose payload equals that of a larger page_id, the largest one.

    Pages are counted by digest first; only digests of several pages are joined back, salted.
    """
    payload = F.coalesce("html", F.lit(""))
    facts = pages.select("page_id", F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).alias("n_bytes"))
    facts = facts.filter(F.col("n_bytes") >= least)
    several = facts.groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("pages")).filter("pages > 1")
    salted = several.select("sha1", "n_bytes", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    facts = facts.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    found = facts.join(salted, ["sha1", "n_bytes", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.filter("refers_to IS NOT NULL").select("page_id", "sha1", "refers_to").distinct()


def chunk_records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """The chunked record table: page_id, url, sha1 and n_bytes of the whole payload, refers_to, chunk_no from 0,
    is_last, chunk, sha1_so_far.

    A row of `pages` gives at least one row here; its rows stand together and in order. A null html is an empty payload;
    a revisit's one chunk is empty. A null page_id is written under the id null and can refer to others; repeated rows
    are records each, and equal ones of the same page_id are all responses.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes"))
    found = revisits(pages, least).withColumnsRenamed({"page_id": "_page", "sha1": "_sha1"})
    joined = keyed.join(found, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left")
    rows = joined.select("page_id", "url", "sha1", "n_bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"))
    schema = "page_id long, url string, sha1 string, n_bytes long, refers_to long, chunk_no int, is_last boolean, chunk binary, sha1_so_far string"
    return rows.mapInArrow(lambda batches: _chunked(batches, chunk_bytes), schema)


def _chunked(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "html"):
        out: list[tuple] = []
        held = 0
        for i, value in enumerate(batch.column("html").fill_null("").cast(pa.binary())):
            view = memoryview(value.as_buffer())
            state = hashlib.sha1()
            for k, start in enumerate(range(0, max(1, len(view)), chunk_bytes)):
                piece = view[start : start + chunk_bytes]
                state.update(piece)
                out.append((i, k, start + chunk_bytes >= len(view), bytes(piece), state.copy().hexdigest()))
                held += len(piece)
                if held >= BATCH_BYTES:
                    yield _chunks(batch, out)
                    out, held = [], 0
        if out:
            yield _chunks(batch, out)


def _chunks(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    origin, number, last, chunks, digests = zip(*rows, strict=True)
    columns = [batch.column(c).take(pa.array(origin, pa.int32())) for c in _FIELDS]
    columns += [pa.array(number, pa.int32()), pa.array(last), pa.array(chunks, pa.binary()), pa.array(digests)]
    return pa.RecordBatch.from_arrays(columns, names=[*_FIELDS, "chunk_no", "is_last", "chunk", "sha1_so_far"])


def write_archives(chunks: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write a partition of the chunked record table as a .warc.gz; one row per file: path, n_records.

    A record's chunks must stand together and in order, as chunk_records leaves them; a table that was stored is dealt by
    page_id and sorted by (page_id, sha1, chunk_no) first. Empty partitions write no file.
    """
    files = chunks.mapInArrow(lambda batches: _write_archive(batches, folder, date), "path string, n_records long")
    return materialize(files, "archives")


def _write_archive(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    batches = (b for b in batches if b.num_rows)
    first = next(batches, None)
    if first is None:
        return
    system, root = open_folder(folder)
    path, n = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
    with whole_file(system, path) as out:
        out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x-archive:info>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        for batch in chain([first], batches):
            for row in zip(*(batch.column(c).to_pylist() for c in (*_FIELDS, "chunk_no", "is_last", "sha1_so_far")), batch.column("chunk"), strict=True):
                page, url, sha1, n_bytes, refers_to, number, last, so_far, chunk = row
                if last and refers_to is None and so_far != sha1:
                    raise ValueError(f"the chunks of page {page} do not add up to its digest")
                out.write(_segment(page, url, sha1, n_bytes, refers_to, number, last, chunk.as_py(), date))
                n += number == 0
    yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))


def _name(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def _segment(page, url, sha1, n_bytes, refers_to, number, last, chunk: bytes, date: str) -> bytes:
    kind = "revisit" if refers_to is not None else "continuation" if number else "response"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _name(page) if not number else f"{_name(page)[:-1]}:{number + 1}>"), ("WARC-Date", date)]
    if number:
        fields += [("WARC-Segment-Origin-ID", _name(page)), ("WARC-Segment-Number", number + 1)]
        if last:
            fields.append(("WARC-Segment-Total-Length", len(_HTTP) + n_bytes))
        return _member(fields, chunk)
    fields += [("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Length", n_bytes)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if refers_to is not None:
        return _member([*fields, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _name(refers_to))], _HTTP)
    return _member(fields if last else [*fields, ("WARC-Segment-Number", 1)], _HTTP + chunk)


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n") + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def members(stream, block: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file one by one; a member is a segment and so of bounded size."""
    state, parts, data = zlib.decompressobj(31), [], b""
    while data := data or stream.read(block):
        parts.append(state.decompress(data))
        data = state.unused_data
        if state.eof:
            yield b"".join(parts)
            state, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("an archive ends within a record")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, n_segments.

    A task per file. Digest and length of a response are computed from its segments as they pass, and must equal what
    its header says; a revisit's are those of its header.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, n_segments int"
    spread = files.select("path").coalesce(1).repartition(max(1, files.count()))  # dealt in turn from one list of names
    return spread.mapInArrow(lambda batches: _read_archives(batches, folder), schema)


_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("n_segments", pa.int32())]
)


def _read_archives(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, _ = open_folder(folder)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = []
            with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                for row in _records(members(stream)):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)


def _page(name: str) -> int | None:
    number = name.strip("<>").rsplit(":", 1)[1]
    return None if number == "null" else int(number)


def _records(parts: Iterator[bytes]) -> Iterator[tuple]:
    held: list | None = None
    state = hashlib.sha1()

    def done() -> tuple:
        page, url, n, sha1, kind, refers_to, segments, told = held
        if kind == "response" and (state.hexdigest(), n) != (sha1, told):
            raise ValueError(f"the payload of page {page} does not match its header")
        return page, url, told, sha1, kind, refers_to, segments

    for raw in parts:
        head, _, block = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = memoryview(block)[: int(fields["Content-Length"])]
        kind = fields["WARC-Type"]
        if kind == "continuation":
            if held is None or fields["WARC-Segment-Origin-ID"] != _name(held[0]):
                raise ValueError("a continuation does not follow its record")
            state.update(block)
            held[2] += len(block)
            held[6] += 1
            continue
        if held is not None:
            yield done()
            held = None
        if kind in ("response", "revisit"):
            state = hashlib.sha1(block[len(_HTTP) :])
            refers_to = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
            held = [_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], len(block) - len(_HTTP), fields["WARC-Payload-Digest"][5:], kind, refers_to, 1, int(fields["X-Payload-Length"])]
    if held is not None:
        yield done()


def op1_warc_chunks(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as the archives that were written
    from `pages` read back; a null html is an empty payload.
    """
    folder = shared_folder(spark, "warc")
    files = write_archives(chunk_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY digest, n)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON g.digest = p.digest AND g.n = p.n
"""
