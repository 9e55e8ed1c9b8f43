import hashlib
import random
from collections import defaultdict

import pytest

from tessella.llm import lines
from tessella.llm.queries import ORACLE_SQL, QUERIES

BLANKS = " \t\n\v\f\r"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=40, documents=5):
    """(doc_id, n_lines, n_dropped, text) of each row."""
    key = lambda line: line.strip(BLANKS).translate(SMALL)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        gone = [len(key(p)) >= least and len(holders[key(p)]) >= documents and doc != max(d for d in holders[key(p)] if d is not None) for p in parts]
        out.append((doc, len(parts), sum(gone), "\n".join(p for p, g in zip(parts, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def found(frame):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in frame.collect()], key=repr)


def made(n, seed=5):
    random.seed(seed)
    common = ["The same long line of words that stands in many documents, Éà", "X" * 40, "é" * 40, "é" * 39, "y" * 39, "  \tMiXed " + "case " * 9 + "\r", "漢" * 41]
    out = []
    for i in range(n):
        own = [f"a line of document {i} alone, number {j} of its own, in full length" for j in range(random.randint(0, 3))]
        own += [random.choice(common).swapcase() if random.random() < 0.2 else random.choice(common) for _ in range(random.randint(0, 4))]
        random.shuffle(own)
        out.append("\n".join(own) + random.choice(["", "\n", "\r\n"]))
    return out


@pytest.mark.parametrize("most_bits", [30, 16])
def test_lines_like_brute_force(spark, docs_of, most_bits):
    texts = made(120) + [None, "", "\n", "\n\n", "a\x00b"]
    docs = docs_of(texts).repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(lines.drop_repeated_lines(docs, most_bits=most_bits)) == brute(rows)
    assert found(lines.drop_repeated_lines(docs, least=5, documents=2)) == brute(rows, 5, 2)


def test_full_filter_suspects_every_line_and_stays_exact(spark, docs_of, monkeypatch):
    monkeypatch.setattr(lines, "LEAST_BITS", 16)
    texts = ["\n".join(f"line {i * 40 + j:>40} of many that fill the filter" for j in range(3000)) for i in range(40)]
    docs = docs_of(texts).repartition(4)
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.drop_repeated_lines(docs, most_bits=16).collect()}
    assert got == {r[0]: (r[1], r[2]) for r in brute(list(enumerate(texts)))}


def test_repeated_ids_and_nulls(spark, docs_of):
    line = "one line that stands in all of these documents here"
    ids = [1, 1, 2, 3, 4, 5, 5, 5, None, None]
    texts = [line, line + "\nx", "a\n" + line, line, line, line + "\n" + line, line + "\n" + line, "b\n" + line, line, line]
    docs = docs_of(texts, ids=ids)
    assert found(lines.drop_repeated_lines(docs)) == brute(list(zip(ids, texts, strict=True)))
    nulls = docs_of([line] * 6, ids=[None] * 6)  # one document of no id
    assert [r[2] for r in found(lines.drop_repeated_lines(nulls))] == [0] * 6


def test_clashing_columns_and_empty_table(spark, docs_of):
    docs = docs_of(["a\nb"]).selectExpr("*", "1 AS lines", "2 AS n_lines", "3 AS text_hash", "4 AS lost_doc_id")
    out = lines.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]
    row = out.first()
    assert (row.lines, row.n_lines, row.text_hash, row.lost_doc_id, row._n_lines, row.n_dropped) == (1, 2, 3, 4, 2, 0)
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0


def test_long_texts_and_hot_lines(spark, docs_of):
    hot = "a line that a third of all the rows have, over and over again"
    texts = ["\n".join([hot] * 50 + [str(i)]) for i in range(400)] + ["\n".join(f"{i} {'z' * 50}" for i in range(60_000)), "q" * 3_000_000]
    got = {r.doc_id: r for r in lines.drop_repeated_lines(docs_of(texts).repartition(8)).collect()}
    assert [got[i].n_dropped for i in range(402)] == [50] * 399 + [0, 0, 0]
    assert got[7].text == "7" and got[401].text == texts[401]


def test_query_like_sql_and_brute_force(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(ORACLE_SQL["op13_bloom_lines"]).fetchall())
    rows = QUERIES["op13_bloom_lines"](spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, rows)) == want
    plain = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    assert sorted(map(tuple, rows)) == sorted((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in plain)
