import gzip

import pytest

from tessella.jobs import acquisition
from tessella.sources import readers

FILES = {
    "basics": ["tt1\tmovie\tOne\tEins\t0\t2026\t\\N\t118\tDrama,Sci-Fi", "tt2\tmovie\tTwo\tTwo\t0\t2026\t\\N\t\\N\t\\N", "tt3\tmovie\tThree\tThree\t1\t2026\t\\N\t90\tDrama", "tt4\ttvSeries\tFour\tFour\t0\t2026\t\\N\t50\tDrama"],
    "ratings": ["tt1\t7.5\t1234"],
    "crew": ["tt1\tnm2,nm1\tnm9", "tt2\t\\N\t\\N"],
    "principals": ['tt1\t2\tnm3\tactor\t\\N\t["B"]', 'tt1\t1\tnm1\tactress\t\\N\t["A"]', "tt1\t\\N\tnm8\tactor\t\\N\t\\N", "tt1\t3\tnm2\tdirector\t\\N\t\\N"],
    "names": ["nm1\tAda\t\\N\t\\N\t\\N\t\\N", "nm2\tBen\t\\N\t\\N\t\\N\t\\N", "nm3\tCy\t\\N\t\\N\t\\N\t\\N"],
    "akas": ["tt1\t1\tOne GB\tGB\t\\N\t\\N\t\\N\t0", "tt1\t2\tOne US\tUS\t\\N\t\\N\t\\N\t0", "tt1\t3\tOne US again\tUS\t\\N\t\\N\t\\N\t0"],
}


@pytest.fixture
def tables(spark, tmp_path):
    out = {}
    for name, rows in FILES.items():
        path = tmp_path / f"{name}.tsv.gz"
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write("\n".join(["\t".join(acquisition.BULK_COLUMNS[name]), *rows]) + "\n")
        out[name] = readers.bulk_tsv(spark, str(path), acquisition.BULK_COLUMNS[name])
    return out


def test_bulk_tables_are_joined_around_the_title(tables):
    one, two = acquisition.assemble(tables).orderBy("id").collect()
    assert (one.id, one.title, one.original_title, one.year, one.runtime) == ("tt1", "One US", "Eins", 2026, 118)
    assert one.genres == ["Drama", "Sci-Fi"] and one.akas == ["One GB", "One US again"]
    assert one.directors == ["Ben", "Ada"] and one.writers == ["nm9"]
    assert [(c.name, c.characters) for c in one.top_cast] == [("Ada", '["A"]'), ("Cy", '["B"]'), ("nm8", None)]
    assert (one.imdb_rating, one.imdb_votes) == (7.5, 1234)
    assert (two.title, two.runtime, two.imdb_rating, two.genres, two.directors, two.akas) == ("Two", None, None, [], [], [])


def test_candidates_are_capped_in_id_order(tables):
    kept = acquisition.candidates(tables["basics"], acquisition.Options(candidates=1)).collect()
    assert [r.id for r in kept] == ["tt1"]


def test_details_win_unless_empty_and_rows_are_routed(spark, tables):
    details = spark.createDataFrame(
        [("tt1", "matched", "", "About one", "", "2026-03-01", 0, ["Science Fiction"]), ("tt2", "join_mismatch", "Other", "x", "y", "2026-01-01", 5, [])],
        "id string, status string, title string, overview string, tagline string, release_date string, runtime int, genres array<string>",
    )
    rows = acquisition.enrich(acquisition.assemble(tables), details)
    kept, rejected = acquisition.routed(rows)
    (one,) = acquisition.finished(kept).collect()
    assert (one.title, one.runtime, one.genres, one.window_status) == ("One US", 118, ["Science Fiction"], "verified")
    assert [s.heading for s in one.sections] == ["Overview", "Directed by", "Written by"]
    assert one.text.startswith("Overview\nAbout one") and one.text_length == len(one.text) and len(one.content_hash) == 64
    assert one.quick_facts == {"runtime": "118", "imdb_rating": "7.5"}
    assert [(r.id, r.reason) for r in rejected.collect()] == [("tt2", "join_mismatch")]
    counts = acquisition.report(acquisition.finished(kept), rejected).first()
    assert (counts.kept, counts.verified, counts.rejected) == (1, 1, 1)


def test_release_window_is_inclusive(spark):
    rows = spark.createDataFrame([("a", "t", "2026-01-01"), ("b", "t", "2026-12-31"), ("c", "t", "2025-12-31"), ("d", "t", "2026"), ("e", "t", None)], "id string, title string, release_date string")
    from pyspark.sql import functions as F

    kept, rejected = acquisition.routed(rows.withColumn("status", F.lit("matched")))
    assert {r.id: r.window_status for r in kept.collect()} == {"a": "verified", "b": "verified", "d": "unverified", "e": "unverified"}
    assert [(r.id, r.reason) for r in rejected.collect()] == [("c", "outside_release_window")]
