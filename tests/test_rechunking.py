import hashlib
import random
from collections import Counter

import pytest

from tessella.jobs.queries import QUERIES, _sectioned
from tessella.operators.chunking import Options
from tessella.operators.rechunking import join_tiny, rechunk, split_document

SCHEMA = "id string, place_in long, title string, text string, sections array<struct<heading:string,content:string>>, facts map<string,string>"
SMALL = Options(size=60, overlap=10, least=12)


def under(text, title, facts, first, prefix):
    if not prefix:
        return text.strip()
    shown = " | ".join(f"{' '.join(w.capitalize() for w in k.replace('_', ' ').split(' '))}: {v}" for k, v in sorted((facts or {}).items()) if v)
    return "\n".join([f"Movie: {(title or '').strip()}", *([f"Quick facts: {shown}"] if first and shown else []), "", text.strip()]).strip()


def one_by_one(rows, options, by_section=True, prefix=True, strategy="section_aware"):
    """Documents in order, texts seen so far beside: (id, text) of chunks, and (document_id, reason) of errors."""
    chunks, errors, seen = [], [], set()
    for doc, _, title, text, sections, facts in sorted(rows, key=lambda r: r[1]):
        if not (doc or "").strip():
            errors.append((doc, "missing_document_id"))
            continue
        if not (text or "").strip() and not any((s[1] or "").strip() for s in sections or []):
            errors.append((doc, "missing_text_and_sections"))
            continue
        n = 0
        named = None if sections is None else [{"heading": h, "content": c} for h, c in sections]
        for _, piece in split_document(title, text, named, options, by_section):
            whole = under(piece, title, facts, n == 0, prefix)
            if not whole or len(whole) < options.least:
                errors.append((doc, "chunk_below_minimum" if whole else "empty_text"))
            elif whole not in seen:
                seen.add(whole)
                chunks.append((f"{doc}::{strategy}::{n}", whole))
                n += 1
        if not n:
            errors.append((doc, "document_produced_no_chunks"))
    return sorted(chunks), Counter(errors)


def made(n, seed):
    random.seed(seed)
    words = ["alpha beta.", "gamma delta epsilon!", "zeta", "eta theta iota kappa lambda mu nu?", "the same long sentence that stands in many of the documents here.", ""]
    rows = []
    for i in range(n):
        title, facts = random.choice(["A", "B", None]), random.choice([{"run_time": "90", "b": ""}, {"lang": "en"}, None, {}])
        sections = [(random.choice(["One", "Two", None, " "]), " ".join(random.choices(words, k=random.randint(0, 5)))) for _ in range(random.randint(0, 5))]
        rows.append((random.choice([f"d{i}"] * 12 + ["", None]), 1000 - i, title, random.choice([None, "", " ".join(random.choices(words, k=6)), "zeta"]), random.choice([sections] * 3 + [None]), facts))
    return rows


@pytest.mark.parametrize(("by_section", "prefix", "least"), [(True, True, 12), (True, False, 12), (False, True, 12), (False, False, 20), (True, True, 40)])
def test_like_going_through_documents_one_by_one(spark, by_section, prefix, least):
    rows, options, strategy = made(120, least), Options(60, 10, least), "section_aware" if by_section else "recursive"
    chunks, errors = rechunk(spark.createDataFrame(rows, SCHEMA).repartition(5), options, "place_in", strategy, prefix=prefix)
    want, wrong = one_by_one(rows, options, by_section, prefix, strategy)
    got = chunks.collect()
    assert sorted((r.id, r.text) for r in got) == want and want
    assert all(r.content_hash == hashlib.sha256(r.text.encode()).hexdigest() and r.char_len == len(r.text) for r in got)
    assert Counter((r.document_id, r.reason) for r in errors.collect()) == wrong and wrong


def test_documents_that_depend_on_one_another_in_a_row(spark):
    # each document's first text is the one before's second without facts, so each choice changes the next one
    facts = {"k": "v"}
    rows = [(f"d{i}", i, "T", None, [("H", f"text number {j} of a chain of documents") for j in (i, i + 1)], facts) for i in range(6)]
    rows += [(f"e{i}", 10 + i, "T", None, [("H", "text number 0 of a chain of documents"), ("H", f"text number {i} of a chain of documents")], facts) for i in range(6)]
    chunks, _ = rechunk(spark.createDataFrame(rows, SCHEMA), Options(60, 10, 12), "place_in")
    assert sorted((r.id, r.text) for r in chunks.collect()) == one_by_one(rows, Options(60, 10, 12))[0]


def test_headings_stand_in_the_text_and_tiny_sections_move():
    parts = [{"heading": h, "content": c} for h, c in (("Cast", "short"), ("Plot", "a plot of enough length"), ("", "x" * 130), ("End", "fin"))]
    got = split_document("T", "unused", parts, SMALL)
    assert got[0] == ("Plot", "Cast\n\nshort\n\nPlot\n\na plot of enough length")
    assert got[1][1].startswith("Overview\n\nxxx") and got[-1][0] == "Overview" and got[-1][1].endswith("End\n\nfin")
    assert split_document("T", None, parts[:1], SMALL) == [("T", "Cast\n\nshort")]
    assert split_document("T", None, [parts[0], parts[3]], SMALL) == [("Cast", "Cast\n\nshort\n\nEnd\n\nfin")]
    assert join_tiny(["a", "bbbb", "c", "dddd"], 3) == ["a\n\nbbbb\n\nc", "dddd"] and join_tiny(["a"], 3) == ["a"] and join_tiny(["a", "b"], 9) == ["a\n\nb"]


def test_no_documents(spark):
    chunks, errors = rechunk(spark.createDataFrame([], SCHEMA), SMALL, "place_in")
    assert chunks.count() == 0 and errors.count() == 0


def test_queries_like_one_by_one(spark, sf_dir):
    rows = [(str(r.id), r.id, r.title, r.text, [tuple(s) for s in r.sections], r.facts) for r in _sectioned(spark, sf_dir).collect()]
    want, wrong = one_by_one(rows, Options())
    got = QUERIES["section_chunks"](spark, sf_dir).collect()
    assert sorted((r.id, r.content_hash) for r in got) == [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want]
    reasons = Counter()
    for (_, reason), n in wrong.items():
        reasons[reason] += n
    assert {r.reason: r.n for r in QUERIES["section_rejects"](spark, sf_dir).collect()} == reasons
