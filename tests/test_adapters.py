"""Alias files, documents as film records, ranks with a floor of votes, and what is said where nothing matches."""

import json

import pytest

from tessella.operators import catalog, records
from tessella.sources import readers


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ({"a": "b", " c ": " d ", "": "x", "e": " ", "f": 1, "g": None}, {("a", "b"), ("c", "d")}), ({"aliases": {"a": "b"}, "c": "d"}, {("a", "b")}),
        ({"aliases": ["a"]}, set()), ([1], set()), ("text", set()), (None, set()),
    ],
)
def test_alias_files(spark, tmp_path, content, want):
    (tmp_path / "a.json").write_text(json.dumps(content, indent=1))
    assert {tuple(r) for r in readers.alias_file(spark, str(tmp_path / "a.json")).collect()} == want


def test_alias_files_that_are_none(spark, tmp_path):
    assert readers.alias_file(spark, str(tmp_path / "missing.json")).collect() == []
    (tmp_path / "b.json").write_text("{no json")
    assert readers.alias_file(spark, str(tmp_path / "b.json")).collect() == []


def test_documents_as_records(spark):
    rows = [(1, 90, ["A", " ", None, "B"], "u", "f"), (2, None, None, None, None)]
    one, two = records.of_documents(spark.createDataFrame(rows, "id int, runtime_minutes int, top_cast array<string>, url string, source_file string")).orderBy("id").collect()
    assert (one.imdb_id, one.runtime, [tuple(c) for c in one.top_cast], one.source_urls) == ("1", 90, [("A", "[]"), ("B", "[]")], {"pdf": "u", "local_file": "f"})
    assert (two.imdb_id, two.runtime, two.top_cast, two.source_urls, two.window_status) == ("2", None, [], {"pdf": "", "local_file": ""}, "fictional_mock")


def test_vote_floor(spark):
    rows = spark.createDataFrame([(1, "a", 9.0, 999), (2, "b", 8.0, 1000), (3, "c", 9.5, None), (4, "d", None, 5000)], "id int, title string, rating double, votes int")
    assert [r.id for r in catalog.rated(rows, "rating", "votes", "title", "id").collect()] == [2]
    assert [r.id for r in catalog.rated(rows, "rating", "votes", "title", "id", least_votes=0).collect()] == [1, 2]


def test_nothing_matched(spark):
    said = lambda years, **more: catalog.no_matches_text(spark.createDataFrame([(y,) for y in years], "year int"), "year", **more).first().answer
    assert said([2026, None, 0], person="ann LEE") == "No movies featuring Ann Lee were found in this 2026 dataset."
    assert said([2025, 2026], person="ann", narrowed=True) == "No movies matched all requested filters for Ann in this dataset."
    assert said([], person="ann") == "No movies featuring Ann were found in this dataset."
    assert said([]) == "No movies matched those structured filters."
