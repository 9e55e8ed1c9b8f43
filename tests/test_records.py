"""Loose records, metadata keys, golden sets and the longest title in a question."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import golden, index, lookup, records


def normal(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, j string").select("n", F.try_parse_json("j").alias("record"))
    return records.normalized(rows)


def test_loose_values_fit_or_are_empty(spark):
    names = F.transform("top_cast", lambda p: records.text_at(p, "name")).alias("names")
    found = normal(
        spark,
        '{"imdb_id": " tt1 ", "title": "\\n A ", "year": 12.7, "runtime": "12.7", "imdb_votes": true, "imdb_rating": " 7.5 ", "genres": ["a", 1, null, " ", "b "], "akas": "x, y,,", "top_cast": [{"name": "N", "age": 3}, {"name": " "}, {"x": 1}, 5, null], "source_urls": {"imdb": "u"}}',
        '{"imdb_id": "", "id": 7, "title": null, "year": "", "runtime": [1], "imdb_votes": {"a": 1}, "imdb_rating": "bad", "genres": 5, "akas": {"a": "b"}, "top_cast": "N", "source_urls": ["u"]}',
        "[1]", "not json", None,
    ).select("n", "imdb_id", "title", "year", "runtime", "imdb_votes", "imdb_rating", "genres", "akas", names, "source_urls").orderBy("n").collect()
    assert tuple(found[0]) == (0, "tt1", "A", 12, None, 1, 7.5, ["a", "1", "b"], ["x", "y"], ["N"], {"imdb": "u"})
    assert tuple(found[1]) == (1, "7", "", None, None, None, None, [], [], [], {})
    assert all(tuple(r)[1:] == ("", "", None, None, None, None, [], [], [], {}) for r in found[2:])


def test_public_columns_and_addresses(spark):
    rows = normal(spark, '{"id": "a", "url": "own", "source_urls": {"imdb": "film"}}', '{"id": "b", "url": "own", "source_urls": {"imdb": ""}}', '{"id": "c"}')
    assert [r.url for r in records.public(rows).orderBy("imdb_id").collect()] == ["film", "own", ""]
    assert records.public(rows).columns == list(records.PUBLIC)
    looked_up = records.public(rows, akas=True).columns
    assert "akas" in looked_up and "tmdb_vote_average" not in looked_up
    ids = spark.createDataFrame([("tt1", "5", "w"), ("tt2", None, "")], "i string, t string, a string")
    both, best = records.addresses(F.col("i"), F.col("t"), F.col("a"))
    one, two = ids.select(both.alias("both"), best.alias("best")).collect()
    assert one.both == {"imdb": "https://www.imdb.com/title/tt1/", "tmdb": "https://www.themoviedb.org/movie/5", "wikipedia": "w"} and one.best == one.both["tmdb"]
    assert two.both == {"imdb": two.best} and two.best == "https://www.imdb.com/title/tt2/"


def test_identity_lines(spark):
    rows = spark.createDataFrame([("A", "B ", ["C", "D"]), ("A", "A", []), ("A", None, None)], "t string, o string, k array<string>")
    found = [r[0] for r in rows.select(records.identity(F.col("t"), F.col("o"), F.col("k"))).collect()]
    assert found == ["Title: A\nOriginal title: B\nAlso known as: C, D", "Title: A", "Title: A"]


def test_metadata_keys(spark):
    rows = spark.createDataFrame([({"A b!": "1", "__x--Y_": "2", "z": None},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in rows.select(records.metadata_fields(F.col("m"))).collect()] == [{"qf_a_b": "1", "qf_x_y": "2"}, {}, {}]
    same = spark.range(1).select(records.metadata_fields(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("A "), F.lit("3"))))
    assert same.first()[0] == {"qf_b": "2", "qf_a": "3"}


ITEM = "id string, category string, split string, answerable string, human_verified string, gold_answer string, document_ids array<string>, source_urls array<string>, quotes array<string>, searched_for string"
DOCS = [("d1", "One  two\nTHREE straße."), ("d2", None), ("d1", "again")]


def wrong(spark, items, minima):
    docs = spark.createDataFrame(DOCS, "id string, text string")
    return golden.errors(spark.createDataFrame(items, ITEM), docs, minima)


def test_golden_rules(spark):
    long = " ".join(["ünd"] * 26)
    items = [
        ("ok", "a", "dev", "true", "true", "x", ["d1", "d2"], ["u", "v"], [" two three ", ""], None),
        ("fold", "a", "dev", "TRUE ", "false", "x", ["d1"], ["u"], ["STRASSE"], ""),
        ("flag", "a", "test", "maybe", "true", None, [], [], [], None),
        ("bare", "b", "nowhere", "true", "true", " ", None, ["u"], None, "it"),
        ("hop", "multi_hop", "test", "true", "true", "x", ["d1", "d1"], ["u", "v"], [long, "four"], None),
        ("gone", None, "dev", "true", "true", "x", ["d9", "d2"], ["u", "v"], [long, "y"], None),
        ("shut", "a", "test", "false", "true", None, ["d1"], [], [], " "),
        ("shut", "a", "test", "false", "true", None, [], [], [], "it"),
    ]
    found = {(r.id, r.position, r.error) for r in wrong(spark, items, {"a": 2, "b": 3, "multi_hop": 1, "c": 0}).collect()}
    assert found == {
        ("flag", None, "flag_must_be_true_or_false"), ("bare", None, "split_must_be_dev_or_test"), ("bare", None, "answerable_without_answer"),
        ("bare", None, "documents_and_urls_must_align"), ("bare", None, "answerable_with_searched_for"), ("hop", None, "multi_hop_needs_two_documents"),
        ("hop", 0, "quote_too_long"), ("hop", 0, "quote_not_found"), ("hop", 1, "quote_not_found"), ("gone", None, "unsupported_category"),
        ("gone", 0, "unknown_document"), ("gone", 1, "quote_not_found"), ("shut", None, "evidence_without_answer"), ("shut", None, "searched_for_missing"),
        ("shut", None, "duplicate_id"), (None, None, "too_few_items"), (None, None, "split_is_not_60_40"), (None, None, "too_few:b"), (None, None, "no_dev:b"),
        (None, None, "no_test:b"), (None, None, "no_dev:multi_hop"), (None, None, "no_dev:c"), (None, None, "no_test:c"),
    }


def test_golden_summary(spark):
    good = [(f"q{n}", "a", "dev" if n < 24 else "test", "true" if n else "false", "true", "x", ["d1"] * (n > 0), ["u"] * (n > 0), ["two"] * (n > 0), "" if n else "it") for n in range(40)]
    for items, want in [(good, (40, 39, 1, 40, 0, True, True)), (good[:-1] + [good[-1][:4] + ("false",) + good[-1][5:]], (40, 39, 1, 39, 0, True, False)), ([], (0, 0, 0, 0, 4, False, False))]:
        found = wrong(spark, items, {"a": 1})
        assert tuple(golden.summary(spark.createDataFrame(items, ITEM), found).first()) == want


def test_longest_title_is_that_of_brute_force(spark):
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("ab_ ") for _ in range(n))
    titles = [word(draw.randint(0, 14)) for _ in range(150)] + ["A", None, "", "zz-top"]
    queries = [(n, word(draw.randint(0, 60))) for n in range(80)] + [(80, None), (81, "see ZZ_top ab"), (82, "")]
    found = lookup.longest_contained(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame([(t,) for t in titles], "t string"), "t")
    plain = lambda s: " ".join(s.replace("_", " ").replace("-", " ").split()).lower()
    named = [t for t in titles if t and plain(t)]
    want = {n: max((t for t in named if plain(t) in plain(q)), key=lambda t: (len(t), t), default=None) if q else None for n, q in queries}
    assert {r.query_id: r.title for r in found.collect()} == want


@pytest.mark.parametrize("few", [200_000, 1])
def test_places_of_questions_are_never_broadcast(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(index, "BROADCAST_TERMS", few)
    spark.range(3000).selectExpr("id AS query_id", "concat('which of all the many parts is ', repeat(concat(id, ' '), 5), 'ring ', id % 7) AS query").write.parquet(f"{tmp_path}/q")
    spark.range(5).selectExpr("concat('ring ', id) AS t").unionByName(spark.range(20_000).selectExpr("concat(sha1(string(id)), ' is nowhere') AS t")).write.parquet(f"{tmp_path}/t")
    questions = spark.read.parquet(f"{tmp_path}/q")
    key = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "32m")  # a hash table takes 16 at least
    try:
        found = lookup.longest_contained(questions.unionByName(questions.limit(9)), spark.read.parquet(f"{tmp_path}/t"), "t").collect()
    finally:
        spark.conf.set(key, before)
    assert {r.query_id: r.title for r in found} == {n: f"ring {n % 7}" if n % 7 < 5 else None for n in range(3000)} and len(found) == 3000


@pytest.mark.parametrize(
    "question, want",
    [
        ("The release date of runtime?", ("release_date", "March 5, 2026")), ("Who Directed it?", ("directors", "A, B")), ("Who wrote it?", ("writers", "")),
        ("its runtime", ("runtime", "118 minutes")), ("What genre?", ("genres", "Drama")), ("The lead stars?", ("top_cast", "C, D, E")),
        ("What is it about?", ("overview", "o")), ("Where?", ("unknown", "")),
    ],
)
def test_answers_of_records(spark, question, want):
    row = spark.range(1).selectExpr(
        "date'2026-03-05' AS release_date", "array('A', 'B') AS directors", "CAST(null AS array<string>) AS writers", "118 AS runtime", "array('Drama') AS genres",
        "array('C', 'D', 'E', 'F') AS top_cast", "'o' AS overview",
    )
    assert tuple(row.select(*(c.alias(n) for c, n in zip(golden.record_answer(F.lit(question)), "fv"))).first()) == want
