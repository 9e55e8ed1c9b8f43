import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessella.llm import pieces, token_records  # noqa: E402
from tessella.storage import shared_folder  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a   b\n c ", "a\n \nb", "it's 'x 'S", "<|endoftext|> x<|endoftext|>", "é\x1c x\x85y", "漢字 と かな　x", "😀😀 a b", "x▁y", "\t\tq", "a" * 3000, "1 2²½ 3", "\x00 ﬁ"]


def noise(n, seed=2):
    random.seed(seed)
    letters = "abcdeéüñ'’ .,!?0123\n\t  "
    return ["".join(random.choice(letters) for _ in range(random.randint(0, 200))) for _ in range(n)]


def test_words_encode_as_the_library_does():
    encoder = token_records.WordEncoder(BPE)
    texts = ODD + noise(300)
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == want


def test_added_tokens_are_the_librarys(spark, docs_of):
    from tokenizers import Tokenizer

    fresh, encoder = Tokenizer.from_file(BPE), token_records.WordEncoder(BPE)
    texts = ODD + ["<|endoftext|> x", "a<|endoftext|>", "it's <|endoftext|", "<|endoftext|><|endoftext|>é漢"] + noise(50)
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[len(ODD)] == [50256, 2124]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == want
    folder = shared_folder(spark, "token-test")
    rows = token_records.read_records(token_records.write_records(docs_of(texts), BPE, folder), folder, with_ids=True)
    assert [r.ids for r in rows.orderBy("doc_id").collect()] == [ids + [2] for ids in want]


def test_records_hold_every_document_in_order(spark, docs_of):
    texts = ODD + [None] + noise(20)
    folder = shared_folder(spark, "token-test")
    docs = docs_of(texts, ids=[7 * i % 37 for i in range(len(texts))]).repartition(3)
    files = token_records.write_records(docs, BPE, folder)
    rows = token_records.read_records(files, folder, with_ids=True).orderBy("start").collect()
    encoder = token_records.WordEncoder(BPE)
    at = 0
    for row, (doc, text) in zip(rows, sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), strict=True):
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc, at, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_index_reaches_single_records_and_damage_is_noticed(spark, docs_of):
    folder = shared_folder(spark, "token-test")
    files = token_records.write_records(docs_of(noise(30)), BPE, folder)
    system, _ = token_records.open_folder(folder)
    for part in files.collect():
        places = token_records.shuffled_places(system, part["index"], seed=1)
        with system.open_input_file(part["path"]) as f:
            for doc, offset, n in places:
                f.seek(offset)
                got, ids = token_records.read_payload(f)
                assert got == doc and len(ids) == n
        with system.open_input_stream(part["path"]) as f:
            data = bytearray(f.read())
        data[-6] ^= 1
        with system.open_output_stream(part["path"]) as f:
            f.write(bytes(data))
    with pytest.raises(Exception, match="does not match its checksum"):
        token_records.read_records(files, folder).collect()


def test_no_documents_no_files(spark, docs_of):
    folder = shared_folder(spark, "token-test")
    files = token_records.write_records(docs_of([]), BPE, folder)
    assert files.count() == 0 and token_records.read_records(files, folder).count() == 0


def test_null_and_repeated_ids(spark, docs_of):
    folder = shared_folder(spark, "token-test")
    files = token_records.write_records(docs_of(["a", "b", "b"], ids=[None, 1, 1]), BPE, folder)
    rows = token_records.read_records(files, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1] and [r.start for r in rows] == [0, 2, 4]


def test_sampled_pieces_decode_to_the_text(spark, docs_of):
    texts = ODD + [None] + noise(40)
    docs = docs_of(texts)
    encoded = pieces.encode_sampled(docs, MODEL)
    back = {r.doc_id: r.text for r in pieces.decode_pieces(encoded, MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.lossless for r in pieces.round_trips(docs, MODEL).collect())


def test_draws_depend_on_row_and_seed_alone(spark, docs_of):
    texts = noise(30)
    runs = [{r.doc_id: r.piece_ids for r in pieces.encode_sampled(docs_of(texts).repartition(n), MODEL, seed).collect()} for n, seed in ((1, 5), (7, 5), (1, 6))]
    assert runs[0] == runs[1] and runs[0] != runs[2]
    again = pieces.encode_sampled(docs_of(["the same text"] * 200), MODEL).collect()
    assert len({tuple(r.piece_ids) for r in again}) > 1


@pytest.mark.parametrize("long", [64, 2])
def test_samples_follow_the_lattice(monkeypatch, long):
    monkeypatch.setattr(pieces, "LONG", long)
    table = pieces.lattice(MODEL)
    n = 60_000
    ids, offsets = table.sample(["thed"] * n, np.arange(n).astype(np.uint64), 3)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True))
    logs = dict(zip(table.ids.tolist(), table.logs.tolist(), strict=True))
    spelt = {table.bytes_of[i]: i for i in table.ids.tolist()}

    def paths(text):
        if not text:
            yield ()
        for k in range(1, len(text) + 1):
            if text[:k] in spelt:
                for rest in paths(text[k:]):
                    yield (spelt[text[:k]], *rest)

    weights = {p: np.exp(sum(logs[i] for i in p)) for p in paths(b" thed")}
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    for path, weight in weights.items():
        assert abs(seen[path] / n - weight / total) < 0.01


def test_no_rows(spark, docs_of):
    assert pieces.round_trips(docs_of([]), MODEL).count() == 0


def test_very_long_texts(spark, docs_of):
    texts = ["word " * 60_000, "x" * 120_000, "\n" * 50_000, "é" * 40_000]
    docs = docs_of(texts)
    assert all(r.lossless for r in pieces.round_trips(docs, MODEL).collect())
    folder = shared_folder(spark, "token-test")
    rows = token_records.read_records(token_records.write_records(docs, BPE, folder), folder).orderBy("doc_id").collect()
    encoder = token_records.WordEncoder(BPE)
    assert [r.n_tokens for r in rows] == [len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
