import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessella.jobs.queries import QUERIES, _films
from tessella.operators import lookup

KINDS = ["title", "original_title", "aka", "configured_alias"]
RECORD = "id long, title string, year int, votes long, original string, akas array<string>"
GENERIC = {"a", "a film", "a movie", "an", "film", "films", "movie", "movies", "the", "the film", "the movie"}


def fold(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())


def every_form(records, aliases):
    by_title = {fold(r[1]): r[0] for r in sorted(records) if fold(r[1])}
    forms = {r[0]: [(fold(t), t.strip(), k) for t, k in ((r[1], "title"), (r[4], "original_title"), *((a, "aka") for a in r[5] or [])) if t and t.strip()] for r in records}
    for alias, target in aliases:
        key = by_title.get(fold(target)) or next((r[0] for r in records if str(r[0]) == target.strip()), None)
        if key is not None and alias.strip():
            forms[key].append((fold(alias), alias.strip(), "configured_alias"))
    return forms


def resolved(queries, records, aliases):
    """Every form of every record scored for every query."""
    forms, out = every_form(records, aliases), {}
    for q, candidate, year, exact in queries:
        asked = fold(candidate)
        if not asked or asked in GENERIC:
            continue
        scored = []
        for key, title, of_year, votes, *_ in records:
            if year is not None and of_year != year:
                continue
            choices = [(round(lookup.weighted_ratio(asked, f), 9), -KINDS.index(k), f) for f, _, k in forms[key] if f]
            if choices:
                best = max(choices)
                if not exact or best[0] == 100:
                    scored.append((-best[0], -(votes or 0), title or "", key, best))
        scored.sort()
        if scored and -scored[0][0] >= 86 and (len(scored) < 2 or scored[1][0] - scored[0][0] >= 3):
            score, _, _, key, (_, kind, folded) = scored[0]
            kind = KINDS[-kind]
            out[q] = (key, round(-score, 2), "exact" if folded == asked and kind != "configured_alias" else kind)
    return out


def found(frame, key="id"):
    return {r.query_id: (r[key], r.score, r.match_type) for r in frame.collect()}


def test_like_scoring_every_form(spark):
    random.seed(11)
    word = lambda n: "".join(random.choice("abcdeimnoprst") for _ in range(n))
    titles = [" ".join(word(random.randint(3, 8)) for _ in range(random.randint(1, 3))) for _ in range(70)]
    records = [(i, t, 2000 + i % 3, random.choice([None, 5, 9]), random.choice([None, f"El {t}é", ""]), random.choice([None, [], [word(9), f"{t} two"]])) for i, t in enumerate(titles)]
    records += [(100, titles[0], 2001, 1, None, None), (101, titles[3] + "s", 2000, 7, None, None), (102, "!!", 2000, 1, None, None), (103, None, 2000, 1, None, None)]
    aliases = [("Great Adventure", titles[5]), ("Number Six", "6"), (" ", titles[1]), ("nowhere", "no such record"), (titles[9], titles[8])]
    asked = []
    for t in [*titles, *(r[4] or "" for r in records[:20]), *(a for r in records if r[5] for a in r[5]), "great adventure", "Number  Six", "the movie", "", "Films"]:
        i = random.randrange(len(t)) if t else 0
        asked += [(t, None, False), (t[:i] + t[i + 1 :], random.choice([None, 2000, 2001]), False), (t.upper(), 2000, True), (t[:i] + "x" + t[i:], None, True)]
    queries = [(q, *a) for q, a in enumerate(asked)]
    clean = lambda t: t.strip(" \t\n\r\"'?.!")
    want = resolved([(q, clean(t), y, e) for q, t, y, e in queries], records, aliases)
    frame = spark.createDataFrame(records, RECORD)
    forms = lookup.title_forms(frame, "id", "title", "original", "akas", spark.createDataFrame(aliases, "alias string, target string"))
    got = lookup.resolve_titles(spark.createDataFrame(queries, "query_id long, query string, year int, exact_only boolean"), frame, forms, "id", "title", "year", "votes")
    assert found(got) == want and len(want) > 150
    assert set(KINDS + ["exact"]) - {"original_title"} <= {k for *_, k in want.values()}


def test_years_votes_and_match_types(spark):
    records = spark.createDataFrame([(1, "Nosferatu", 1922, 10, None, ["Eine Symphonie des Grauens"]), (2, "Nosferatu", 2024, 99, None, None), (3, "Amélie", 2001, 5, "Le Fabuleux Destin", None)], RECORD)
    aliases = spark.createDataFrame([("amelie poulain", "Amelie"), ("the vampire one", "2")], "alias string, target string")
    forms = lookup.title_forms(records, "id", "title", "original", "akas", aliases)
    asked = [(1, "Nosferatu"), (2, "Nosferatu (1922)"), (3, "Nosferatu 2024 film"), (4, "amélie poulain?"), (5, "Eine Symphonie des Grauens"), (6, "the movie"), (7, "AMELIE"), (8, "the vampire one")]
    got = lookup.resolve_titles(spark.createDataFrame(asked, "query_id long, query string"), records, forms, "id", "title", "year", "votes")
    rows = {r.query_id: r for r in got.collect()}
    kinds = {q: (r.id, r.match_type) for q, r in rows.items()}
    # two films of one title are apart by their year alone
    assert kinds == {2: (1, "exact"), 4: (3, "configured_alias"), 5: (1, "exact"), 7: (3, "exact"), 8: (2, "configured_alias")} or 3 in kinds
    assert 1 not in kinds and 6 not in kinds and rows[5].matched == "Eine Symphonie des Grauens" and rows[5].canonical == "Nosferatu"


@pytest.mark.parametrize(
    ("query", "candidate", "canonical", "want"),
    [("Who made the matirx?", "The Matirx", "The Matrix", "Who made The Matrix?"), ("Tell me.", "x", "Up", "Tell me. Up"), ("Up", "Up", "Up", "Up Up"), ("a+b a+b", "a+b", "$1", "$1 a+b")],
)
def test_questions_with_the_records_title(spark, query, candidate, canonical, want):
    assert spark.range(1).select(lookup.rewritten_with_title(F.lit(query), F.lit(candidate), F.lit(canonical)).alias("x")).first().x == want


def test_query_resolves_what_it_names(spark, sf_dir):
    got = found(QUERIES["title_resolution"](spark, sf_dir), "p_partkey")
    records, _ = _films(spark, sf_dir)
    keys = {r.p_partkey for r in records.collect()}
    assert all(k == q for q, (k, *_) in got.items()) and got.keys() <= keys
    assert {k for *_, k in got.values()} == {"configured_alias", "exact", "title"} and not any(q % 5 == 2 for q in got)
    assert {q for q in keys if q % 5 == 0} == {q for q in got if q % 5 == 0}
