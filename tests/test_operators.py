import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.jobs import indexing, publish
from tessella.operators import answers, catalog, chunking, conversation, evaluation, index, lookup, relational, retrieval
from tessella.sources import pages, readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.normalize(F.lit("  Sci-Fi__and/More  x")), "sci fi and more x"),
        (lambda: T.squeeze(F.lit("  a \n b  c "), 3), "a b"),
        (lambda: T.nullable(F.lit("\\N")), None),
        (lambda: T.lenient_int(F.lit("12")), 12),
        (lambda: T.lenient_int(F.lit("1x")), None),
        (lambda: T.items_of(F.lit(" a, ,b ")), ["a", "b"]),
        (lambda: T.duration_minutes(F.lit("PT2H5M")), 125),
        (lambda: T.duration_minutes(F.lit("P1DT1H")), 60),
        (lambda: T.duration_minutes(F.lit("two hours")), None),
        (lambda: T.spoken_minutes(F.lit("1 hour 58 minutes")), 118),
        (lambda: T.word_count(F.lit("it's a well-known fact")), 4),
        (lambda: T.citation_numbers(F.lit("x [2] and [1], [2]")), [2, 1]),
        (lambda: T.packed_items(F.lit("a || b || ")), ["a", "b"]),
        (lambda: T.natural_join(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), "a, b, and c"),
        (lambda: T.natural_join(F.array(F.lit("a"), F.lit("b"))), "a and b"),
        (lambda: T.safe_name(F.lit("run 1/x")), "run_1_x"),
        (lambda: T.chunk_tokens(F.lit("abcde")), 2),
    ],
)
def test_functions(spark, column, want):
    assert one(spark, column()) == want


@pytest.mark.parametrize(("text", "good"), [("2026-03-01", True), ("2026", False), ("2026-3-1", False), ("20260301", False), ("2026-13-01", False)])
def test_dates_are_strict(spark, text, good):
    assert (one(spark, T.iso_date(F.lit(text))) is not None) == good


def test_titles_are_folded_and_hashes_canonical(spark):
    rows = spark.createDataFrame([("Amélie: Le Film!", '{"b": 1, "a": "é", "fetched_at": 3}'), (None, None)], "t string, j string")
    first, second = rows.select(T.fold_title("t").alias("t"), T.canonical_hash("j").alias("h")).collect()
    import hashlib

    assert first.t == "amelie le film" and first.h == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()
    assert second.t is None and second.h is None


def test_filters_and_people(spark):
    rows = spark.createDataFrame(
        [(1, 2026, ["Sci-Fi"], 7.0, ["Paul Walker"], "2026-05-01"), (2, 2026, ["Drama"], None, ["Walker Evans"], None), (3, None, [], 9.0, ["Jean-Paul Walker"], "2026-06-02")],
        "id int, year int, genres array<string>, rating double, people array<string>, day string",
    ).withColumn("day", F.to_date("day"))
    ids = lambda c: [r.id for r in rows.filter(c).orderBy("id").collect()]
    assert ids(catalog.Filters(equal={"year": 2026}).condition()) == [1, 2]
    assert ids(catalog.Filters(member={"genres": "sci fi"}).condition()) == [1]
    assert ids(catalog.Filters(least={"rating": 7.0}).condition()) == [1, 3]
    assert ids(catalog.Filters(months={"day": [6]}).condition()) == [3]
    assert ids(catalog.Filters(known=("day",)).condition()) == [1, 3]
    assert ids(catalog.name_has_tokens(F.col("people"), ["paul", "walker"])) == [1, 3]


def test_last_and_first_win(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, None)], "k string, seq int, v string")
    assert sorted((r.k, r.v) for r in relational.last_wins(rows, ["k"], [F.col("seq")]).collect()) == [("a", "y"), ("b", None)]
    assert sorted((r.k, r.v) for r in relational.first_wins(rows, ["k"], [F.col("seq")]).collect()) == [("a", "x"), ("b", None)]


def test_run_merge_needs_keys(spark):
    a, b = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2, "e")], "k string, v int, w string")
    assert [(r.k, r.v, r.w) for r in relational.run_merge([a, b], "k").collect()] == [("a", 2, "e")]
    with pytest.raises(Exception, match="has no k"):
        relational.run_merge([a, spark.createDataFrame([(None, 1)], "k string, v int")], "k").collect()


def test_recursive_pieces_stay_in_size():
    random.seed(5)
    text = " ".join("".join(random.choice("abc") for _ in range(random.randint(1, 9))) + random.choice(["", ".", "\n", "\n\n"]) for _ in range(400))
    pieces = chunking.split_recursive(text, 220, 40)
    assert all(0 < len(p) <= 220 for p in pieces)
    assert set(text.split()) <= {w for p in pieces for w in p.split()}


def test_sections_carry_tiny_ones(spark):
    options = chunking.Options(220, 40, 80)
    long = "This is a sentence of the plot. " * 12
    docs = spark.createDataFrame([("d1", None, [("Intro", "tiny"), ("Middle", "m" * 100), ("Plot", long)]), ("d2", "only text here " * 10, None), ("", "x", None), ("d4", " ", [])], "id string, text string, sections array<struct<heading:string,content:string>>")
    chunks, errors = chunking.rechunk(docs, options)
    rows = chunks.orderBy("id").collect()
    first = [r for r in rows if r.document_id == "d1"]
    assert [r.chunk_number for r in first] == list(range(len(first))) and first[0].text.startswith("tiny\n\nmmm")
    assert all(r.char_len == len(r.text) <= 220 and r.id == f"{r.document_id}::section_aware::{r.chunk_number}" for r in rows)
    assert sorted((r.id, r.reason) for r in errors.collect()) == [("", "missing_document_id"), ("d4", "missing_text_and_sections")]


def test_bm25_prefers_the_rare_term(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "common other"), (4, None), (5, "other words here")], "id long, text string")
    queries = spark.createDataFrame([(0, "rare"), (0, "common")], "query_id long, term string")
    scores = index.bm25_scores(index.postings(docs, "id"), index.text_lengths(docs, "id"), queries, "id").orderBy(F.desc("score")).collect()
    assert scores[0].id == 1 and {r.id for r in scores} == {1, 2, 3}


def test_blocks_of_texts_and_queries_change_no_list(spark, monkeypatch):
    draw, folder = random.Random(8), retrieval.shared_folder(spark, "weights")
    entries = [(q, 9.5, [(t, t, 0.5 + n) for n, t in enumerate("abcdef") if draw.random() < 0.6]) for q in range(7)]
    spark.createDataFrame(entries, "query_id long, avg_len double, entries array<struct<term:string,word:string,idf:double>>").write.parquet(folder)
    tokens = [draw.choices("abcdefgh"[: 1 + n % 8], k=draw.choice([0, 1, 9, 30])) for n in range(90)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(91)), pa.array(tokens, pa.list_(pa.string()))], names=["id", "tokens"])

    def lists():
        rows = [r for b in retrieval._best_texts(iter([batch, batch.slice(91)]), folder, 8) for r in b.to_pylist()]
        firsts = {q: sorted((-r["score"], r["id"]) for r in rows if r["query_id"] == q)[:8] for q in range(7)}
        return {q: [i for _, i in rows] for q, rows in firsts.items()}

    whole = lists()
    for name, size in {"QUERY_BLOCK": 2, "TEXT_BLOCK": 11, "TOKEN_BLOCK": 60, "COUNT_BLOCK": 3}.items():
        monkeypatch.setattr(retrieval, name, size)
    assert all(whole.values()) and lists() == whole


@pytest.mark.parametrize("stemmed", [False, True])
def test_sparse_topk_equals_scores_of_all_pairs(spark, stemmed):
    draw = random.Random(5)
    words = ["run", "runs", "running", "cat", "cats", "a", "of", "zebra", "été", "x9"]
    rows = [(f"d{n}", None if n == 3 else " ".join(draw.choice(words[: 2 + n % 9]).title() for _ in range(draw.choice([0, 1, 5, 40])))) for n in range(60)]
    docs = spark.createDataFrame(rows + [(f"e{n}", rows[9][1]) for n in range(9)], "id string, text string").repartition(3)
    asked = spark.createDataFrame([(q, t) for q in range(5) for t in draw.sample(["run", "cat", "a", "of", "zebra", "et", "x9", "nowhere"], 3)] + [(9, "nowhere")], "query_id int, term string")
    if stemmed:
        token, posted, meant = index.WORD, index.stemmed_postings(docs, "id"), index.word_stems(docs, only=asked)
    else:
        token, posted, meant = index.TOKEN, index.postings(docs, "id"), None
    scores = index.bm25_scores(posted, index.text_lengths(docs, "id", token=token), asked, "id").withColumn("score", F.round("score", 9))
    plain = lambda frame: sorted((r.query_id, r["rank"], r.id, r.score) for r in frame.collect())
    got, want = plain(retrieval.sparse_topk(docs, asked, 6, "id", token=token, words=meant)), plain(retrieval.ranked_lists(scores, "id", 6))
    assert len(want) > 20 and [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-9)
    assert retrieval.sparse_topk(docs.limit(0), asked, 6, "id").count() == 0


def test_hybrid_shuffles_no_text_of_its_chunks(spark, tmp_path):
    spark.range(60).selectExpr("id", "id div 3 AS doc", "concat(repeat('alpha ', id), id) AS text").write.parquet(f"{tmp_path}/c")
    lists = spark.range(60).selectExpr("0L AS query_id", "id", "int(id) + 1 AS rank")
    asked = spark.createDataFrame([(0, "alpha")], "query_id long, text string")
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        found = retrieval.hybrid(lists, lists, spark.read.parquet(f"{tmp_path}/c"), asked, "id", "doc")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 5
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin [id#" in plan and "SortMergeJoin [id#" not in plan


def test_vector_errors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, None)], "id long, v array<double>")
    got = {r.id: r.error for r in index.vector_errors(rows, "v", 2).collect()}
    assert got == {1: None, 2: "wrong_dimension", 3: "zero_vector", 4: "not_finite", 5: "not_normalised", 6: "missing_vector"}


def test_index_reuses_cached_vectors_and_sweeps(spark):
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("a", "one", digest("one")), ("b", "two", digest("two")), ("c", "bad", "0"), ("d", "", digest(""))]
    calls = []

    first = indexing.build(spark.createDataFrame(rows[:1], "id string, text string, content_hash string"))
    cache = first["cache"]
    second = indexing.build(spark.createDataFrame(rows, "id string, text string, content_hash string"), cache, spark.createDataFrame([("a",), ("z",)], "id string"))
    assert {(r.id, r.error) for r in second["errors"].collect()} == {("c", "content_hash_mismatch"), ("d", "missing_text")}
    assert {r.id for r in second["vectors"].collect()} == {"a", "b"} and [r.id for r in second["stale"].collect()] == ["z"]
    assert second["cache"].count() == 2 and indexing.parity(second["vectors"], second["lengths"]) and not calls


def test_fusion_keeps_the_strongest_appearance(spark):
    rows = spark.createDataFrame([(0, "x", 1, 0.5, None), (1, "x", 3, 0.9, 2.0), (1, "y", 1, 0.9, 2.0), (2, "x", 2, 0.9, 2.0)], "attempt int, k string, rank int, score double, rerank_score double")
    got = {r.k: (r.fused, r.attempt) for r in retrieval.fuse_attempts(rows, "k").collect()}
    assert got == {"x": (round(1 / 61 + 1 / 63 + 1 / 62, 8), 1), "y": (round(1 / 61, 8), 1)}


def test_hybrid_drops_near_duplicates_and_caps_documents(spark):
    chunks = spark.createDataFrame([(1, 1, "alpha beta gamma"), (2, 1, "alpha beta gamma."), (3, 1, "alpha delta"), (4, 1, "alpha epsilon"), (5, 2, "zeta")], "id long, doc long, text string")
    lists = spark.createDataFrame([(0, i, i) for i in (1, 2, 3, 4, 5)], "query_id long, id long, rank int")
    asked = spark.createDataFrame([(0, "alpha")], "query_id long, text string")
    rows = retrieval.hybrid(lists, lists, chunks, asked, "id", "doc").orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 3, 5] and rows[0].score > 0.9 > rows[2].score


def test_dense_topk_over_blocks_equals_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 7)
    x = np.random.default_rng(1).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>").repartition(5)
    queries = rows.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.dense_topk(rows, queries, 3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.clip(u[:5] @ u.T, 0, 1)
    for q in range(5):
        want = np.lexsort((np.arange(60), -scores[q]))[:3]
        assert [got[q, k] for k in (1, 2, 3)] == want.tolist()


@pytest.mark.parametrize(("a", "b", "low", "high"), [("same", "same", 100, 100), ("the future film", "future film the", 94, 100), ("futur film", "future film", 90, 99), ("abc", "xyz", 0, 1), ("film", "a title with film in it", 80, 91)])
def test_weighted_ratio(a, b, low, high):
    assert low <= lookup.weighted_ratio(a, b) <= high


def test_fuzzy_lookup_refuses_ambiguity(spark):
    titles = spark.createDataFrame([(1, "The Future Film"), (2, "The Future Films"), (3, "Quiet Harbor")], "id long, title string")
    asked = spark.createDataFrame([(10, "the future film"), (11, "quiet harbr"), (12, "nothing like it")], "query_id long, query string")
    assert {r.query_id: r.id for r in lookup.fuzzy_titles(asked, titles, "id", "title").collect()} == {10: 1, 11: 3} or {r.query_id for r in lookup.fuzzy_titles(asked, titles, "id", "title").collect()} == {11}


def test_fuzzy_lookup_equals_scoring_every_title(spark):
    random.seed(5)
    word = lambda n: "".join(random.choice("abcdeimnoprst") for _ in range(n))
    titles = ["oppenheimer", "a", "ab", "up", "cat", "oppenheimers", "the cat", *(word(random.randint(2, 12)) for _ in range(150))]
    titles += [f"{word(random.randint(2, 8))} {word(random.randint(3, 9))}" for _ in range(60)]
    asked = ["openheimer", "cats", "b", "a a b", "xppenheimer", "heimer"]
    for t in titles:
        i = random.randrange(len(t))
        asked += [t[:i] + t[i + 1 :], t[:i] + "z" + t[i + 1 :], " ".join(reversed((t[:i] + "e" + t[i:]).split()))]
    norm = lambda t: " ".join(t.lower().split())
    want = {}
    for q, query in enumerate(asked):
        scores = sorted(((lookup.weighted_ratio(norm(query), norm(t)), -k) for k, t in enumerate(titles)), reverse=True)
        if scores[0][0] >= 86 and scores[0][0] - scores[1][0] >= 3:
            want[q] = (-scores[0][1], round(scores[0][0], 6))
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    catalog = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    got = {r.query_id: (r.id, round(r.score, 6)) for r in lookup.fuzzy_titles(queries, catalog, "id", "title").collect()}
    assert got == want and len(want) > 100


def test_item_metrics(spark):
    rows = spark.createDataFrame([([1, 2], [3, 1, 2]), ([], [1]), ([9], [1])], "gold array<int>, found array<int>")
    a, b, c = evaluation.item_metrics(rows).collect()
    assert (a.recall_5, a.rr) == (1.0, 0.5) and abs(a.ndcg_10 - 0.6934) < 1e-3
    assert b.recall_5 is None and b.rr is None and (c.recall_20, c.rr, c.ndcg_10) == (0.0, 0.0, 0.0)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, "g", float(i % 7)) for i in range(40)], "id long, k string, v double")
    runs = [evaluation.bootstrap_means(rows.repartition(n), "v", "k", samples=200).first() for n in (1, 5)]
    assert abs(runs[0].low - runs[1].low) < 1e-9 and runs[0].low < runs[0].mean < runs[0].high


def test_history_and_references(spark):
    rows = spark.createDataFrame([(1, 0, "user", "who made it"), (1, 1, "assistant", "x"), (1, 2, "user", "who directed THAT film"), (1, 3, "system", "s")], "conv_id long, turn long, role string, text string")
    assert [(r.turn, r.position) for r in conversation.last_turns(rows, 2).orderBy("turn").collect()] == [(1, 1), (2, 2)]
    assert [(r.turn, r.answer_turn) for r in conversation.with_reference(rows).orderBy("turn").collect()] == [(0, None), (2, 1)]


def test_answers(spark):
    rows = spark.createDataFrame([(0, 2, "B", "two"), (0, 1, "A", "one")], "query_id long, rank int, title string, text string")
    found = answers.evidence(rows).first()
    assert found.context == "[1] A\none\n\n[2] B\ntwo" and found.sources == 2
    assert one(spark, answers.citations_valid(F.lit("as [2] says"), F.lit(2))) and not one(spark, answers.citations_valid(F.lit("as [3] says"), F.lit(2)))
    assert one(spark, answers.refusal(F.lit(0), F.lit(1.0))) == "out_of_scope"
    assert one(spark, answers.refusal(F.lit(2), F.lit(-5.0))) == "not_in_sources"
    assert one(spark, answers.refusal(F.lit(2), F.lit(None).cast("double"))) is None


def test_films_from_json_ld(spark):
    film = '{"@graph": [{"@type": "Movie", "name": "One &amp; Two", "genre": ["Drama"], "duration": "PT1H", "director": [{"name": "Ada"}, {"name": "Ada"}], "keywords": "a, b", "aggregateRating": {"ratingValue": "7.5", "ratingCount": "12,345"}}]}'
    rows = spark.createDataFrame([(1, "u", f'<html><script type="application/ld+json">{film}</script></html>'), (2, "u", "<html>none</html>"), (3, "u", None)], "page_id long, url string, html string")
    good, none, null = pages.films(rows).orderBy("page_id").collect()
    assert (good.title, good.directors, good.keywords, good.rating, good.rating_count) == ("One & Two", ["Ada"], ["a", "b"], 7.5, 12345)
    assert none.error == null.error == "missing_json_ld"


def test_lenient_json_and_seeds(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\n[1]\nnot json\n')
    good, bad = readers.lenient_json(spark, str(tmp_path / "x.jsonl"), spark.createDataFrame([], "id string").schema)
    assert [r.id for r in good.collect()] == ["a"]
    assert sorted(r.reason for r in bad.collect()) == ["document_must_be_an_object", "invalid_json"]
    (tmp_path / "seeds.txt").write_text("# list\nhttps://www.example.com/title/tt1/?x=1\nhttps://example.com/title/tt1\nhttps://example.com/title/tt2/\n")
    found = readers.seed_urls(spark, str(tmp_path / "seeds.txt"), "example.com", "^/title/(tt[0-9]+)").collect()
    assert sorted(r.id for r in found) == ["tt1", "tt2"]
    (tmp_path / "bad.txt").write_text("https://other.org/title/tt1/\n")
    with pytest.raises(Exception, match="not a title address"):
        readers.seed_urls(spark, str(tmp_path / "bad.txt"), "example.com", "^/title/(tt[0-9]+)").collect()


def test_question_set(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes('﻿id,answerable,ids\n1,TRUE,a || b\n2,false,\n'.encode())
    a, b = readers.question_set(spark, str(tmp_path / "q.csv"), ["ids"], ["answerable"]).orderBy("id").collect()
    assert (a.answerable, a.ids, b.answerable, b.ids) == (True, ["a", "b"], False, [])


def test_publish_keeps_the_old_generation(spark, tmp_path):
    base = f"file://{tmp_path}/run"
    table = spark.createDataFrame([(1,)], "a int")
    assert publish.current(spark, base) is None
    assert publish.publish({"chunks": table}, base, "chunks")["generation"] == 1
    with pytest.raises(ValueError, match="no rows"):
        publish.publish({"chunks": table.limit(0)}, base, "chunks")
    assert publish.load(spark, base, "chunks").count() == 1
    assert publish.publish({"chunks": table.union(table)}, base, "chunks")["generation"] == 2
    assert publish.load(spark, base, "chunks").count() == 2


def test_stream_in_append_mode_holds_back_the_last_day(spark, sf_dir, tmp_path):
    from tessella.streaming import querylog

    log = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events*.parquet")
    run = querylog.daily(log).writeStream.outputMode("append").format("memory").queryName("held").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert 0 < spark.table("held").count() < querylog.daily_counts(spark, sf_dir).count()


def test_quotes_and_question_rules(spark):
    docs = spark.createDataFrame([("d1", "A  long\nstory here."), ("d2", None)], "id string, text string")
    asked = spark.createDataFrame(
        [("q1", "Who?", True, ["d1", "d2", "d9"], ["long story", "x", "y"]), ("q2", " ", True, [], []), ("q3", "film of 1999", False, ["d1"], ["w " * 30])],
        "id string, question string, answerable boolean, document_ids array<string>, quotes array<string>",
    )
    got = {(r.id, r.position): r.status for r in evaluation.quote_support(asked, docs).collect()}
    assert got == {("q1", 0): "supported", ("q1", 1): "missing_document", ("q1", 2): "missing_document", ("q3", 0): "quote_not_found"}
    errors = {r.id: r.errors for r in evaluation.question_errors(asked, banned=r"\bfilms?\b").collect()}
    assert errors == {"q1": [], "q2": ["empty_question", "answerable_without_document"], "q3": ["unanswerable_with_document", "quote_too_long", "domain_term"]}


def test_relaxation_and_strength(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "query_id long, k string")
    got = sorted((r.query_id, r.k, r.relaxed) for r in retrieval.relaxed(rows.filter("query_id = 0 AND k = 'a'"), rows).collect())
    assert got == [(0, "a", False), (1, "c", True)]
    attempts = spark.createDataFrame([(0, None, 0.9), (1, -2.0, 0.1), (1, -3.0, 0.8)], "attempt int, rerank_score double, score double")
    best = {r.attempt: (r.rerank_score, r.score) for r in retrieval.strength(attempts, "attempt").collect()}
    assert best == {0: (float("-inf"), 0.9), 1: (-2.0, 0.1)}


def test_caches_seeds_and_texts(spark):
    cache = spark.createDataFrame([("a", "matched", "2026-01-01", "2020-01-01 00:00:00"), ("b", "no_match", None, "2020-01-01 00:00:00"), ("c", "matched", "", "2026-01-01 23:00:00")], "id string, status string, release_date string, fetched_at string")
    cache = cache.withColumn("fetched_at", F.to_timestamp("fetched_at"))
    assert sorted(r.id for r in relational.fresh(cache, F.lit("2026-01-02 00:00:00").cast("timestamp"), 24).collect()) == ["a", "c"]
    seeds = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r.id for r in relational.unfinished(seeds, spark.createDataFrame([("a", "completed"), ("b", "failed")], "id string, status string"), "id").collect()] == ["b"]
    good, bad = relational.text_catalog(spark.createDataFrame([("x",), ("y",), ("z",)], "slug string"), spark.createDataFrame([("x", "t" * 200), ("y", "t")], "slug string, text string"))
    assert [r.slug for r in good.collect()] == ["x"] and sorted((r.slug, r.reason) for r in bad.collect()) == [("y", "text_too_short"), ("z", "missing_text")]


def test_log_appends_with_defaults(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for query in ("one", "two"):
        publish.append_log(spark.createDataFrame([(query, "answered")], "query string, decision string"), path)
    rows = spark.read.json(path).collect()
    assert {r["query"] for r in rows} == {"one", "two"} and len({r["id"] for r in rows}) == 2 and {r["review_status"] for r in rows} == {"unreviewed"}


def test_references_are_resolved_to_the_one_source_of_the_latest_answer(spark):
    rows = [
        (1, 1, "user", "hello", None), (1, 2, "assistant", "a", ["Heat $5 \\ x", " Heat $5 \\ x "]), (1, 3, "user", " Who is in it, and who made THIS  Film? ", None),
        (1, 4, "user", "what about its director?", None), (1, 5, "user", "And the cast", None), (1, 6, "user", "its rating?", None), (1, 7, "user", "the writers.", None),
        (1, 8, "user", "Tell me more!", None), (1, 9, "user", "this is their own, those items", None), (1, 10, "assistant", "b", []), (1, 11, "user", "what else", None),
        (1, 12, "assistant", "c", ["A", "B"]), (1, 13, "user", "tell me more", None), (1, 14, "user", None, None), (2, 1, "user", "tell me more", None),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, titles array<string>")
    got = {(r.conv_id, r.turn): (r.rewritten, r.referenced_title) for r in conversation.resolved_references(turns).collect()}
    title = "Heat $5 \\ x"
    want = {3: f"Who is in {title}, and who made {title}?", 4: f"Who directed {title}?", 5: f"Who is in {title}?", 6: f"What is the rating of {title}?", 7: f"Who wrote {title}?",
            8: f"Tell me more about {title}", 11: f"Tell me more about {title}"}
    assert got == {(1, t): (want[t], title) if t in want else (None, None) for t in (1, 3, 4, 5, 6, 7, 8, 9, 11, 13, 14)} | {(2, 1): (None, None)}
    assert conversation.resolved_references(turns.limit(0)).count() == 0


def test_titles_match_without_their_accents(spark):
    catalog = spark.createDataFrame([(1, "Am\u00e9lie"), (2, "Amelie!"), (3, "\u6f22\u5b57"), (4, None)], "id long, title string")
    asked = spark.createDataFrame([(7, "AM\u00c9LIE"), (8, "\u6f22"), (9, None)], "query_id long, query string")
    assert sorted((r.query_id, r.id, r.matches) for r in lookup.exact_titles(asked, catalog, "title").collect()) == [(7, 1, 2), (7, 2, 2)]


def test_bootstrap_draws_are_poisson():
    times = evaluation._poisson(np.arange(400, dtype=np.uint64), 1000, 3)
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02 and abs(np.corrcoef(times[0], times[1])[0, 1]) < 0.15


def test_tiny_pieces_join_forward_and_backward():
    options = chunking.Options(size=40, overlap=0, least=10)
    long = "x" * 20
    assert chunking.merge_tiny([("a", "tiny"), ("b", long), ("c", "end")], options) == [("b", f"tiny\n\n{long}\n\nend")]
    assert chunking.merge_tiny([("a", "one"), ("b", "two")], options) == [("b", "one\n\ntwo")]
    assert chunking.merge_tiny([("a", "tiny"), ("b", "x" * 40)], options) == [("a", "tiny"), ("b", "x" * 40)]
    assert chunking.merge_tiny([("a", "lone")], options) == [("a", "lone")]
    assert chunking.merge_tiny([], options) == []


def test_confident_titles_need_the_title_and_a_year_or_film(spark):
    rows = [("Heat", 1995, "Heat (1995 film)"), ("Heat", 1995, "Heat (1986)"), ("Heat", None, "Heat, a film"), (None, 1995, "Heat 1995"), ("Heat", 1995, None)]
    frame = spark.createDataFrame(rows, "title string, year int, article string")
    found = frame.select(lookup.confident_title(F.col("title"), F.col("year"), F.col("article")).alias("sure"))
    assert [r.sure for r in found.collect()] == [True, False, True, False, False]


def test_fields_match_by_their_own_rules(spark):
    rows = [
        ("runtime", "1 hour 58 minutes", "118", True), ("runtime", "two hours", "118", False), ("runtime", None, "0", False),
        ("release_date", "On  May 5, 1999", "may 5, 1999", True), ("directors", "by Ann B. Lee", "Lee, Ann", True),
        ("directors", "by Ann", "Lee, Ann", False), ("genres", "Drama", "", False), ("genres", "Drama", None, False),
    ]
    frame = spark.createDataFrame(rows, "field string, expected string, canonical string, want boolean")
    found = frame.select("want", evaluation.field_matches(F.col("field"), F.col("expected"), F.col("canonical")).alias("agrees")).collect()
    assert [r.agrees for r in found] == [r.want for r in found]


def test_overlay_takes_the_last_value_that_is_not_null(spark):
    a = spark.createDataFrame([(1, "a", 1, "x", None), (1, "b", 2, None, "t"), (2, "a", 1, "y", None)], "q int, id string, dense_rank int, url string, title string")
    b = spark.createDataFrame([(1, "b", 1, "u", None, 0.5), (1, "c", 2, None, "s", None)], "q int, id string, sparse_rank int, url string, title string, bm25 double")
    rows = {(r.q, r.id): (r.dense_rank, r.sparse_rank, r.url, r.title, r.bm25, round(r.rrf, 8)) for r in retrieval.overlaid([a, b], ["q", "id"], ["dense_rank", "sparse_rank"]).collect()}
    assert rows == {
        (1, "a"): (1, None, "x", None, None, round(1 / 61, 8)), (1, "b"): (2, 1, "u", "t", 0.5, round(1 / 62 + 1 / 61, 8)),
        (1, "c"): (None, 2, None, "s", None, round(1 / 62, 8)), (2, "a"): (1, None, "y", None, None, round(1 / 61, 8)),
    }


def test_baselines_refuse_by_their_gates(spark):
    items = spark.createDataFrame([(1, True, [7, 8]), (2, False, []), (3, True, [9])], "query_id int, answerable boolean, gold array<int>")
    rows = spark.createDataFrame([(1, 7, 1, 0.9), (1, 7, 2, 0.8), (1, 5, 3, 0.7), (1, 8, 4, 0.6), (2, 7, 1, 0.3)], "query_id int, doc int, rank int, score double")
    got = {(r.baseline, r.query_id): r for r in evaluation.baselines(items, {"none": None, "free": rows, "gated": rows}, {"gated": 0.5}, "doc").collect()}
    assert len(got) == 9 and {k: r.status for k, r in got.items() if k[0] != "none"} == {
        ("free", 1): "ok", ("free", 2): "ok", ("free", 3): "no_results", ("gated", 1): "ok", ("gated", 2): "low_confidence", ("gated", 3): "no_results"
    }
    assert got["free", 1].found == [7, 5, 8] and got["free", 1].recall_5 == 1 and got["free", 1].answer_support_5 == 1 and got["none", 1].over_refusal == 1
    assert got["gated", 2].correct_refusal == 1 and got["free", 2].correct_refusal == 0 and got["free", 2].rr is None and got["none", 3].recall_5 == 0


def test_paired_and_rate_intervals_like_numpy(spark):
    rng = np.random.default_rng(4)
    n = 400
    first, second = rng.normal(0.5, 0.2, n), rng.normal(0.55, 0.2, n)
    refused, asked = (rng.random(n) < 0.2).astype(float), rng.integers(1, 4, n).astype(float)
    rows = [(i, b, float(v), float(r), float(a)) for i in range(n) for b, v, r, a in (("B2", first[i], refused[i], asked[i]), ("B3", second[i], 1 - refused[i], asked[i]))]
    frame = spark.createDataFrame([*rows, (n, "B2", 9.0, None, 1.0)], "id long, b string, v double, r double, a double")
    picks = rng.integers(0, n, (5000, n))
    delta = (second - first)[picks].mean(axis=1)
    got = evaluation.bootstrap_pairs(frame, "id", "b", "v", "B2", "B3").first()
    assert got.n == n and got.delta == pytest.approx((second - first).mean())
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(delta, [2.5, 97.5])), abs=0.003)
    rates = {r.b: r for r in evaluation.bootstrap_rates(frame, "id", "r", "a", "b").collect()}
    for name, top in (("B2", refused), ("B3", 1 - refused)):
        want = np.percentile(top[picks].sum(axis=1) / asked[picks].sum(axis=1), [2.5, 97.5])
        assert rates[name].n == n and rates[name].rate == pytest.approx(top.sum() / asked.sum())
        assert (rates[name].low, rates[name].high) == pytest.approx(tuple(want), abs=0.005)
    assert evaluation.bootstrap_pairs(frame.limit(0), "id", "b", "v", "B2", "B3").count() == 0
