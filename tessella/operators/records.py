"""Records of loose JSON brought to one schema, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns that callers see, in their order.
PUBLIC = (
    "imdb_id title original_title release_date year runtime genres imdb_rating imdb_votes tmdb_vote_average "
    "directors writers top_cast overview url source_urls"
).split()


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def text_at(record: Column, name: str) -> Column:
    """A field as text, stripped; numbers and nested values as JSON, nothing as an empty string."""
    return stripped(F.coalesce(F.try_variant_get(record, f"$.{name}", "string"), F.lit("")))


def whole_at(record: Column, name: str) -> Column:
    """A field as an integer: fractions of numbers are cut, texts must be integers; null for everything else."""
    return F.try_variant_get(record, f"$.{name}", "bigint")


def number_at(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "double")


def texts_at(record: Column, name: str) -> Column:
    """A field as texts: a list's items, or a text's between commas; stripped, without empty ones and nulls."""
    is_text = F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant")) == "STRING"
    items = F.when(is_text, F.split(F.try_variant_get(record, f"$.{name}", "string"), ",")).otherwise(F.try_variant_get(record, f"$.{name}", "array<string>"))
    none = F.array().cast("array<string>")
    return F.filter(F.transform(F.coalesce(items, none), stripped), lambda item: item.isNotNull() & (item != ""))


def people_at(record: Column, name: str) -> Column:
    """A list's objects that have a name, whole; other items and other values are left out."""
    people = F.coalesce(F.try_variant_get(record, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(people, lambda person: text_at(person, "name") != "")


def texts_by_key(record: Column, name: str) -> Column:
    """An object's fields as texts; other values give no fields."""
    return F.coalesce(F.try_variant_get(record, f"$.{name}", "map<string,string>"), F.create_map().cast("map<string,string>"))


def normalized(rows: DataFrame, record: str = "record") -> DataFrame:
    """Rows with a VARIANT column, and beside it typed columns of the film that it describes.

    Nothing fails: what does not fit its type is null, an empty list or an empty map. A record that is null or no object
    has an empty id and title, and nulls and empty lists.
    """
    r = F.col(record)
    fields = {
        "imdb_id": F.coalesce(F.nullif(F.try_variant_get(r, "$.imdb_id", "string"), F.lit("")), F.try_variant_get(r, "$.id", "string"), F.lit("")),
        "title": text_at(r, "title"), "original_title": F.try_variant_get(r, "$.original_title", "string"),
        "release_date": F.try_variant_get(r, "$.release_date", "string"), "overview": F.try_variant_get(r, "$.overview", "string"),
        "url": F.try_variant_get(r, "$.url", "string"), "source_urls": texts_by_key(r, "source_urls"), "top_cast": people_at(r, "top_cast"),
    }
    fields["imdb_id"] = stripped(fields["imdb_id"])
    fields |= {name: whole_at(r, name) for name in ("year", "runtime", "imdb_votes")}
    fields |= {name: number_at(r, name) for name in ("imdb_rating", "tmdb_vote_average")}
    fields |= {name: texts_at(r, name) for name in ("genres", "akas", "directors", "writers")}
    return rows.withColumns(fields)


def public(rows: DataFrame, *, akas: bool = False) -> DataFrame:
    """Normalised records as callers see them: the film site's address before the record's own. With akas, titles by which
    a record was looked up stand in place of the second site's average.
    """
    address = F.coalesce(F.nullif(F.col("source_urls")["imdb"], F.lit("")), F.col("url"), F.lit(""))
    shown = [("akas" if akas and name == "tmdb_vote_average" else name) for name in PUBLIC]
    return rows.select(*(address.alias("url") if name == "url" else F.col(name) for name in shown))


def addresses(imdb: Column, tmdb: Column, article: Column) -> tuple[Column, Column]:
    """(addresses by site without those that are missing, the one preferred): the second site's before the first's."""
    film = F.concat(F.lit("https://www.imdb.com/title/"), imdb, F.lit("/"))
    second = F.concat(F.lit("https://www.themoviedb.org/movie/"), F.nullif(tmdb.cast("string"), F.lit("")))
    known = F.map_filter(F.create_map(F.lit("imdb"), film, F.lit("tmdb"), second, F.lit("wikipedia"), F.nullif(article, F.lit(""))), lambda _, v: v.isNotNull())
    return known, F.coalesce(second, film)


def identity(title: Column, original: Column, akas: Column) -> Column:
    """Lines that say which film a text is about: its title, the original one where it differs, other titles."""
    other = F.nullif(stripped(F.coalesce(original, F.lit(""))), F.lit(""))
    named = F.array_join(akas, ", ")
    return F.concat_ws(
        "\n", F.concat(F.lit("Title: "), title), F.when(other != title, F.concat(F.lit("Original title: "), other)),
        F.when(named != "", F.concat(F.lit("Also known as: "), named)),
    )


def metadata_fields(facts: Column) -> Column:
    """A map of texts under keys that an index takes: qf_, letters, digits and single underscores, lower-cased.

    Nulls are left out; of keys that become equal the last one's value stays. A null map is an empty one.
    """
    safe = lambda key: F.concat(F.lit("qf_"), F.lower(F.regexp_replace(F.regexp_replace(key, "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", "")))
    given = F.map_entries(F.coalesce(facts, F.create_map().cast("map<string,string>")))
    pairs = F.transform(F.filter(given, lambda e: e["value"].isNotNull()), lambda e: F.struct(safe(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda i: F.transform(F.slice(pairs, i + 2, F.size(pairs)), lambda e: e["key"])
    return F.map_from_entries(F.filter(pairs, lambda e, i: ~F.array_contains(later(i), e["key"])))


def of_documents(documents: DataFrame) -> DataFrame:
    """Stand-alone documents (id, runtime_minutes, top_cast of names, url, source_file) with the columns of film records beside
    their own. Blank and null names are left out; a null list has none; null addresses are empty.
    """
    # The addresses' keys and the status.
    names = F.filter(F.coalesce("top_cast", F.array().cast("array<string>")), lambda name: F.coalesce(stripped(name), F.lit("")) != "")
    address = F.create_map(F.lit("pdf"), F.coalesce("url", F.lit("")), F.lit("local_file"), F.coalesce("source_file", F.lit("")))
    return documents.withColumns({
        "imdb_id": F.col("id").cast("string"), "runtime": F.col("runtime_minutes"), "top_cast": F.transform(names, lambda name: F.struct(name.alias("name"), F.lit("[]").alias("characters"))),
        "source_urls": address, "window_status": F.lit("fictional_mock"),
    })
