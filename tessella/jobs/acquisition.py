"""Acquisition: six bulk tables joined around a title id, enriched, finished, and reported on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import iso_date, items_of, lenient_double, lenient_int
from tessella.operators.relational import known_text, other_titles

# Columns of the bulk files.
BULK_COLUMNS = {
    "basics": ["tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "runtimeMinutes", "genres"],
    "ratings": ["tconst", "averageRating", "numVotes"],
    "crew": ["tconst", "directors", "writers"],
    "principals": ["tconst", "ordering", "nconst", "category", "job", "characters"],
    "names": ["nconst", "primaryName", "birthYear", "deathYear", "primaryProfession", "knownForTitles"],
    "akas": ["titleId", "ordering", "title", "region", "language", "types", "attributes", "isOriginalTitle"],
}


@dataclass(frozen=True)
class Options:
    year: int = 2026
    first_day: str = "2026-01-01"
    last_day: str = "2026-12-31"
    title_types: tuple[str, ...] = ("movie",)
    region: str = "US"
    language: str = "en"
    include_adult: bool = False
    cast: int = 10
    akas: int = 50
    candidates: int | None = 2500


def candidates(basics: DataFrame, options: Options) -> DataFrame:
    """Kept titles with their base fields; filtered before anything is joined to them."""
    kept = F.col("titleType").isin(*options.title_types) & (F.col("startYear") == str(options.year))
    if not options.include_adult:
        kept &= F.coalesce("isAdult", F.lit("")) != "1"
    rows = basics.filter(kept).select(
        F.col("tconst").alias("id"), F.coalesce("primaryTitle", "tconst").alias("title"), F.coalesce("originalTitle", "primaryTitle", "tconst").alias("original_title"),
        lenient_int(F.col("startYear")).cast("int").alias("year"), lenient_int(F.col("runtimeMinutes")).cast("int").alias("runtime"),
        items_of(F.coalesce("genres", F.lit(""))).alias("genres"),
    )
    return rows.orderBy("id").limit(options.candidates) if options.candidates else rows


def regional_titles(akas: DataFrame, kept: DataFrame, options: Options) -> DataFrame:
    """(id, regional): of each title the aka of the preferred region, else language, the first in file order."""
    score = F.when(F.col("region") == options.region, 2).when(F.col("language") == options.language, 1).otherwise(0)
    rows = akas.join(kept.select("id"), F.col("titleId") == F.col("id"), "left_semi").filter(F.col("title").isNotNull())
    order = F.struct((-score).alias("s"), lenient_int(F.col("ordering")).alias("o"), "title")
    return rows.groupBy(F.col("titleId").alias("id")).agg(F.min_by("title", order).alias("_t"), F.max(score).alias("_s")).select("id", F.when(F.col("_s") > 0, F.col("_t")).alias("regional"))


def cast_lists(principals: DataFrame, kept: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(id, top_cast): actors in billing order, unnumbered ones last, by name where it is known."""
    rows = principals.filter(F.col("category").isin("actor", "actress")).join(kept.select("id"), F.col("tconst") == F.col("id"), "left_semi")
    rows = rows.select(F.col("tconst").alias("id"), F.coalesce(F.nullif(lenient_int(F.col("ordering")), F.lit(0)), F.lit(9999)).alias("o"), "nconst", "characters")
    number = F.row_number().over(Window.partitionBy("id").orderBy("o", "nconst", "characters"))
    top = rows.withColumn("n", number).filter(F.col("n") <= most).join(names.select("nconst", "primaryName"), "nconst", "left")
    person = F.struct(F.coalesce("primaryName", "nconst").alias("name"), F.col("characters"))
    return top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", person.alias("p")))), lambda x: x["p"]).alias("top_cast"))


def credit_lists(crew: DataFrame, kept: DataFrame, names: DataFrame) -> DataFrame:
    """(id, directors, writers) by name, in the order of the lists of ids; both lists are looked up in one join."""
    rows = crew.join(kept.select("id"), F.col("tconst") == F.col("id"), "left_semi")
    lists = F.array(*(F.struct(F.lit(role).alias("role"), items_of(F.coalesce(role, F.lit(""))).alias("ids")) for role in ("directors", "writers")))
    each = rows.select(F.col("tconst").alias("id"), F.explode(lists).alias("l")).select("id", "l.role", F.posexplode("l.ids").alias("pos", "nconst"))
    named = each.join(names.select("nconst", "primaryName"), "nconst", "left").withColumn("name", F.coalesce("primaryName", "nconst"))

    def of(role: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "name"))))
        return F.transform(pairs, lambda p: p["name"]).alias(role)

    return named.groupBy("id").agg(of("directors"), of("writers"))


def assemble(tables: dict[str, DataFrame], options: Options = Options()) -> DataFrame:
    """One row per kept title from the six bulk tables; what a side lacks is null or empty."""
    kept = candidates(tables["basics"], options)
    ratings = tables["ratings"].select(F.col("tconst").alias("id"), lenient_double(F.col("averageRating")).alias("imdb_rating"), lenient_int(F.col("numVotes")).cast("int").alias("imdb_votes"))
    regional = regional_titles(tables["akas"], kept, options)
    rows = kept.join(ratings, "id", "left").join(credit_lists(tables["crew"], kept, tables["names"]), "id", "left")
    rows = rows.join(cast_lists(tables["principals"], kept, tables["names"], options.cast), "id", "left").join(regional, "id", "left")
    rows = rows.withColumn("title", F.coalesce("regional", "title")).drop("regional")
    named = tables["akas"].join(rows.select("id", F.col("title").alias("own"), "original_title"), F.col("titleId") == F.col("id"))
    akas = other_titles(named.filter(F.col("title").isNotNull()), "id", "title", ["own", "original_title"], options.akas).withColumnRenamed("titles", "akas")
    rows = rows.join(akas, "id", "left")
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("directors", "writers", "akas")})


def enrich(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Rows with a table of details (id, status, title, overview, tagline, release_date, runtime, genres).

    A matched row's details win unless empty; empty strings, lists and zero minutes are no values.
    """
    d = details.select("id", *(F.col(c).alias(f"_{c}") for c in ("status", "title", "overview", "tagline", "release_date", "runtime", "genres")))
    joined = rows.join(d, "id", "left")
    matched = F.col("_status") == "matched"
    genres = F.when(matched & (F.coalesce(F.size("_genres"), F.lit(0)) > 0), F.col("_genres")).otherwise(F.col("genres"))
    return joined.withColumns({
        "title": F.when(matched, known_text(F.col("_title"), F.col("title"))).otherwise(F.col("title")),
        "runtime": F.when(matched, F.coalesce(F.nullif("_runtime", F.lit(0)), "runtime")).otherwise(F.col("runtime")),
        "genres": genres, "overview": F.when(matched, F.nullif("_overview", F.lit(""))), "tagline": F.when(matched, F.nullif("_tagline", F.lit(""))),
        "release_date": F.when(matched, F.nullif("_release_date", F.lit(""))), "status": F.coalesce("_status", F.lit("no_match")),
    }).drop("_status", "_title", "_overview", "_tagline", "_release_date", "_runtime", "_genres")


def routed(rows: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and (id, title, reason) of those released outside the window or matched to another title."""
    day = iso_date(F.col("release_date"))
    reason = F.when(F.col("status") == "join_mismatch", "join_mismatch").when(day.isNotNull() & ~day.between(options.first_day, options.last_day), "outside_release_window")
    marked = rows.withColumn("window_status", F.when(day.isNotNull(), "verified").otherwise("unverified")).withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").select("id", "title", "reason", "release_date")


def finished(rows: DataFrame) -> DataFrame:
    """Sections, text, facts and a content hash of each row."""
    parts = {"Overview": F.col("overview"), "Tagline": F.col("tagline"), "Directed by": F.array_join("directors", ", "), "Written by": F.array_join("writers", ", ")}
    sections = F.array(*(F.struct(F.lit(k).alias("heading"), F.coalesce(v, F.lit("")).alias("content")) for k, v in parts.items()))
    used = F.filter(sections, lambda s: F.trim(s["content"]) != "")
    facts = F.map_filter(F.create_map(F.lit("runtime"), F.col("runtime").cast("string"), F.lit("imdb_rating"), F.col("imdb_rating").cast("string")), lambda k, v: v.isNotNull())
    text = F.array_join(F.transform(F.col("sections"), lambda s: F.concat(s["heading"], F.lit("\n"), s["content"])), "\n\n")
    done = rows.withColumn("sections", used).withColumn("text", text).withColumn("quick_facts", facts)
    return done.withColumn("text_length", F.char_length("text")).withColumn("content_hash", F.sha2(F.to_json(F.struct("id", "title", "text", "genres", "runtime")), 256))


def report(kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of counts."""
    good = kept.agg(
        F.count("*").alias("kept"), F.count_if(F.col("window_status") == "verified").alias("verified"), F.count_if(F.col("imdb_rating").isNull()).alias("unrated"),
        F.count_if(F.size("genres") == 0).alias("without_genre"), F.count_if(F.size("sections") == 0).alias("without_text"),
    )
    return good.join(rejected.agg(F.count("*").alias("rejected")))  # a row by a row
