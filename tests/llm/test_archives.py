import hashlib

import pytest

from tessella.llm import warc
from tessella.storage import shared_folder


def archive(spark, rows, chunk=64, least=1000):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    folder = shared_folder(spark, "warc-test")
    files = warc.write_archives(warc.chunk_records(pages, chunk, least), folder)
    return folder, files, warc.read_archives(files, folder).collect()


def test_records_come_back_whole_and_equal_payloads_once(spark):
    big, small = "é" * 700, "x" * 999
    rows = [(1, "u1", big, "?"), (2, "u2", small, None), (3, None, big, None), (5, "u5", small, None), (4, "u\r\n4", None, None), (6, "u6", "\r\n\r\nWARC/1.1\r\n" * 90, None), (7, "u7", "", None)]
    _, _, found = archive(spark, rows)
    got = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert (got[1].record_type, got[1].refers_to, got[3].record_type) == ("revisit", 3, "response")
    assert all(got[p].record_type == "response" and got[p].refers_to is None for p in (2, 3, 4, 5, 6, 7))
    assert got[3].n_segments == -(-1400 // 64) and got[1].n_segments == 1


def test_chunks_carry_digests_so_far(spark):
    pages = spark.createDataFrame([(1, "u", "abcdefghij"), (2, "u", None)], "page_id long, url string, html string")
    rows = warc.chunk_records(pages, 4).orderBy("page_id", "chunk_no").collect()
    assert [(r.page_id, r.chunk_no, bytes(r.chunk), r.is_last) for r in rows] == [(1, 0, b"abcd", False), (1, 1, b"efgh", False), (1, 2, b"ij", True), (2, 0, b"", True)]
    assert [r.sha1_so_far for r in rows[:3]] == [hashlib.sha1(b"abcdefghij"[:n]).hexdigest() for n in (4, 8, 10)]


def test_chunks_of_an_oversized_payload_leave_in_bounded_batches(spark):
    import pyarrow as pa

    html = "abcd" * 6_000_000
    batch = pa.RecordBatch.from_pydict({"page_id": [1], "url": ["u"], "sha1": [""], "n_bytes": [len(html)], "refers_to": pa.array([None], pa.int64()), "html": [html]})
    parts = list(warc._chunked([batch], 1 << 20))
    assert max(p.nbytes for p in parts) < 6 << 20 and sum(p.num_rows for p in parts) == -(-len(html) // (1 << 20))
    _, _, found = archive(spark, [(1, "u", html, "")], 1 << 20)
    assert [(r.payload_bytes, r.payload_digest) for r in found] == [(len(html), hashlib.sha1(html.encode()).hexdigest())]


def test_repeated_and_null_pages(spark):
    text = "y" * 2000
    _, _, found = archive(spark, [(1, "u", text, ""), (1, "u", text, ""), (None, "u", text, ""), (None, None, None, "")])
    kinds = sorted((r.page_id is None, r.record_type, r.refers_to) for r in found if r.payload_bytes)
    assert kinds == [(False, "response", None), (False, "response", None), (True, "revisit", 1)]
    assert sum(r.payload_bytes == 0 for r in found) == 1


def test_no_pages_no_files(spark):
    _, files, found = archive(spark, [])
    assert files.count() == 0 and found == []


def test_damage_is_noticed(spark):
    from pyarrow import fs

    folder, files, _ = archive(spark, [(1, "u", "z" * 5000, "")])
    path = files.first().path
    system, _ = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(path, compression=None) as f:
        data = f.read()
    with system.open_output_stream(path, compression=None) as f:
        f.write(data[:-20])
    with pytest.raises(Exception, match="ends within a record|Error|error"):
        warc.read_archives(files, folder).collect()
