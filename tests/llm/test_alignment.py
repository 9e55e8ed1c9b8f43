import hashlib
import random
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessella.llm import alignment  # noqa: E402
from tessella.llm.queries import QUERIES  # noqa: E402
from tessella.llm.token_records import _byte_letters  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "a ", " a", "\n", "  a   b\n c ", "a\n \n  b", "it's 'x 'S", "<|endoftext|> x<|endoftext|>", "<s> a </s><unk>", "é\x1c x\x85y", "漢字 と かな　x",
    "😀😀 a b", "👩‍👩‍👧 ☃́ é", "x▁y", "a ▁", "\t\tq", "a" * 3000, "1 2²½ 3", "\x00 ﬁ", "﻿a", "ａｂｃ", "\r\n\r\n x", "<0x41> b", "𝔘𝔫𝔦 \U0010ffff",
]
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def whole(texts):
    """Per text its tokens of both kinds, (id, bytes), from the libraries on the whole text; none where bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    letters = {c: n for n, c in _byte_letters().items()}
    out = []
    for text in texts:
        encoded = a.encode(" " + (text or ""), add_special_tokens=False)
        own_a = [(i, bytes(letters[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens, strict=True)]
        own_b = []
        for i in b.encode(text or ""):
            p = b.id_to_piece(i)
            own_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + (text or "")).encode()
        same = text and b"".join(x for _, x in own_a) == want and b"".join(x for _, x in own_b) == want
        out.append((own_a, own_b) if same else ([], []))
    return out


def places(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    known, holders = [], Counter()
    for own_a, own_b in whole(texts):
        a, b = places(own_a), places(own_b)
        links = []
        for i, s, e in a:
            links += [(i, j) for j, t, f in b if s < f and t < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if s >= start and e <= cut) for side in (a, b)))
            start = cut
        known.append((len(a), len(b), len(groups), links, ";".join(groups)))
        holders.update(set(links))
    best = defaultdict(int)
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    return [(na, nb, ng, len(ls), sum(holders[x] == best[x[0]] for x in ls), sum(holders[x] for x in ls), text) for na, nb, ng, ls, text in known]


def digests(rows):
    return [(*r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[0] else "") for r in rows]


def found(frame):
    return [(*(r[c] for c in NUMBERS), r.groups_sha256) for r in frame.orderBy("doc_id").collect()]


def noise(n, seed=4):
    random.seed(seed)
    words = ["the", "über", "naïve", "straße", "漢字", "😀", "12", "don't", "\n", "  ", "▁" if seed == 9 else "x", "é", "\x00", "…", ",", ".", "!?", "a.b", "x,Été.\nWort", ";;", ".\nThe", "3.14,5", "https://a.b/c?d=1"]
    return ["".join(random.choice(words) + random.choice(["", " ", " ", "\t"]) for _ in range(random.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 300])
def test_like_brute_force(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    texts = ODD + noise(60) + noise(20, 9)
    want = brute(texts)
    rows = alignment.align_tokenizers(docs_of(texts).repartition(3), BPE, MODEL, with_groups=True).orderBy("doc_id").collect()
    assert [(*(r[c] for c in NUMBERS), r.groups) for r in rows] == want
    assert [r.groups_sha256 for r in rows] == [d[-1] for d in digests(want)]
    for row, text in zip(rows, texts, strict=True):
        assert len(row.cuts) == row.n_groups and (not row.cuts or row.cuts[-1] == len(text.encode()) + 1)


def test_long_texts_by_segments(monkeypatch):
    monkeypatch.setattr(alignment, "RUN_CHARS", 200)
    texts = noise(1, 1) + [" ".join(noise(30, s)) for s in range(4)] + ["a b" * 300, "é" * 500, "w " * 400, "no▁" + " a b" * 200]
    aligner = alignment.Aligner(BPE, MODEL, with_groups=True)
    for document, want in zip(aligner.documents(texts), brute(texts), strict=True):
        assert tuple(document.numbers) == want[:4] and ";".join(document.text) == want[6]
        keys, times = document.pairs()
        assert times.sum() == want[3] and len(set(keys.tolist())) == len(keys)


def test_long_texts_are_cut():
    parts = list(alignment.segments("some words " * 300_000))
    assert len(parts) == 13 and "".join(parts) == " " + "some words " * 300_000


def test_repeated_rows_nulls_empty_table_and_clashing_columns(spark, docs_of):
    texts = ["the cat", "the cat", "the dog", None]
    docs = docs_of(texts, ids=[1, 1, 2, None]).selectExpr("*", "1 AS block", "2 AS pairs", "3 AS n_a")
    got = sorted(((r.doc_id or 0, r.n_a, r.count_sum) for r in alignment.align_tokenizers(docs, BPE, MODEL).collect()))
    want = brute(texts)
    assert got == sorted((i, w[0], w[5]) for i, w in zip([1, 1, 2, 0], want, strict=True))
    assert alignment.align_tokenizers(docs.limit(0), BPE, MODEL).count() == 0


def test_query_like_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    short = {i for i, t in enumerate(texts) if len(t or "") < 6000}  # comparing all pairs of tokens is quadratic
    got = found(QUERIES["op12_token_alignment"](spark, sf_dir))
    assert len(got) == len(texts)
    want = digests(brute([t if i in short else None for i, t in enumerate(texts)]))
    assert all(got[i][:4] == want[i][:4] and got[i][6] == want[i][6] for i in short)


def odd_joins(n, seed):
    """Short texts of characters whose splits depend on what stands beside them."""
    random.seed(seed)
    marks = [" ", " ", "\n", "\n", "\t", "\x1c", "\x85", "　", "a", "a", "The", "É", "×", "÷", "1", ",", ".", ".", "'s", "'", "&", "漢", "▁", "́", "ſ", "ŀ", "￼"]
    return ["".join(random.choice(marks) for _ in range(random.randint(1, 14))) for _ in range(n)]


def test_units_end_where_words_of_both_end():
    aligner = alignment.Aligner(BPE, MODEL, with_groups=True)
    texts = odd_joins(1500, 5) + ["a\n\nb", ".\n\nThe", "a\n b", "a \nb", "×,a", "x ÷.b", "a.\nThe, b", "The The's The.", "a  b", "a　 b,c", "ſ a ſ", "The ŀa The"]
    found = aligner.documents(texts)
    for text, document, want in zip(texts, found, brute(texts), strict=True):
        assert (*document.numbers, ";".join(document.text)) == (*want[:4], want[6]), repr(text)


def test_units_met_before_are_not_asked_for_again(monkeypatch):
    aligner = alignment.Aligner(BPE, MODEL)
    texts = noise(40, 2)
    first = [(d.numbers.tolist(), d.digest.hexdigest(), *map(list, d.pairs())) for d in aligner.documents(texts)]
    aligner.units.a = aligner.units.b.model = None  # neither library is at hand any more
    again = [(d.numbers.tolist(), d.digest.hexdigest(), *map(list, d.pairs())) for d in aligner.documents(texts[::-1])]
    assert again == first[::-1]
    monkeypatch.setattr(alignment, "MEMO_UNITS", 10)
    aligner = alignment.Aligner(BPE, MODEL)  # forgets all before each text
    assert first == [(d.numbers.tolist(), d.digest.hexdigest(), *map(list, d.pairs())) for t in texts for d in aligner.documents([t])]
