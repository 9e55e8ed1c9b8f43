"""Column helpers for text, numbers and dates: built-in functions only, save where Spark has none."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def normalize(text: Column) -> Column:
    """Dashes, underscores and slashes to blanks, white space squeezed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[-_/]+", " "), r"\s+", " ")))


@pandas_udf(StringType())
def fold_title(titles: pd.Series) -> pd.Series:
    """Compatibility-decomposed, without accents, lower-cased, all but ASCII letters and digits to single blanks."""

    def fold(title: str | None) -> str | None:
        if title is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", title) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())

    return titles.map(fold, na_action="ignore")


# What is stripped from both ends of a title that was cut out of a question.
TITLE_EDGES = " \t\n\r\"'?.!"


def title_candidate(text: Column) -> Column:
    """A title cut out of a question: no year in parentheses, no "movie" or "film" at the end, no blanks or marks around."""
    undated = F.regexp_replace(text, r"\(\s*(?:19|20)\d{2}\s*\)", "")
    return F.btrim(F.regexp_replace(undated, r"(?i)\b(?:movie|film)\b\s*$", ""), F.lit(TITLE_EDGES))


def year_in(text: Column) -> Column:
    """The first year from 1900 to 2099 that stands as a word, null without one."""
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).try_cast("int")


def plain_words(text: Column) -> Column:
    """Lower-cased, all but ASCII letters and digits to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def squeeze(text: Column, most: int | None = None) -> Column:
    """White space collapsed and trimmed; with `most`, cut to so many characters and right-trimmed."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return clean if most is None else F.rtrim(F.substring(clean, 1, most))


def clean_text(text: Column) -> Column:
    """No-break spaces and tabs to blanks, runs of blanks to one, more than one empty line to one."""
    blanks = F.regexp_replace(F.regexp_replace(text, " ", " "), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(blanks, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def nullable(text: Column) -> Column:
    """Null for the empty string and for the two-character null mark of bulk TSV files."""
    return F.nullif(F.nullif(text, F.lit("")), F.lit("\\N"))


def lenient_int(text: Column) -> Column:
    return F.try_to_number(F.when(text.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(text)), F.lit("S" + "9" * 18)).cast("long")


def lenient_double(text: Column) -> Column:
    return text.try_cast("double")


def items_of(text: Column) -> Column:
    """A comma-separated string as its trimmed, non-empty items."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def iso_date(text: Column) -> Column:
    """A date from a string of the form yyyy-mm-dd, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-12) -> Column:
    """A vector over its length, or over `least` if that is longer."""
    size = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / size)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, clamped to 0..1; null where a vector is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b))))


def duration_minutes(text: Column) -> Column:
    """Minutes of an ISO-8601 duration; days are read and left out; null where it is none."""
    parts = [F.regexp_extract(text, r"^P(?:\d+D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$", i) for i in (1, 2)]
    hours, minutes = (F.coalesce(F.nullif(p, F.lit("")).try_cast("int"), F.lit(0)) for p in parts)
    return F.when(text.rlike(r"^P(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$") & (hours * 60 + minutes > 0), hours * 60 + minutes)


def spoken_minutes(text: Column) -> Column:
    """Minutes of "1 hour 58 minutes"; null without either."""
    hours = F.nullif(F.regexp_extract(F.lower(text), r"(\d+)\s*hours?", 1), F.lit("")).try_cast("int")
    minutes = F.nullif(F.regexp_extract(F.lower(text), r"(\d+)\s*minutes?", 1), F.lit("")).try_cast("int")
    return F.when(hours.isNotNull() | minutes.isNotNull(), F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0)))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\b[\w'-]+\b"))


def facts_text(facts: Column) -> Column:
    """A map as "Key: value | ..." by key, underscores to blanks, capitals first, null and empty values left out."""
    used = F.filter(F.map_entries(facts), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    shown = F.transform(F.array_sort(used), lambda e: F.concat(F.initcap(F.regexp_replace(e["key"], "_", " ")), F.lit(": "), e["value"]))
    return F.array_join(shown, " | ")


def citation_numbers(text: Column) -> Column:
    """Distinct n of [n] marks, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int")))


def packed_items(text: Column) -> Column:
    """Items of a list packed with " || "."""
    return F.filter(F.transform(F.split(text, r" \|\| "), lambda x: F.trim(x)), lambda x: x != "")


def chunk_tokens(text: Column) -> Column:
    """Tokens as a quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4)


def month_in(day: Column, months: list[int]) -> Column:
    return F.month(day).isin(months)


def long_date(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")


def natural_join(items: Column, word: str = "and") -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(f", {word} "), F.element_at(items, -1))
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).when(n == 2, F.array_join(items, f" {word} ")).otherwise(many)


def display_name(name: Column) -> Column:
    """White space collapsed and trimmed, each word with a capital first and small letters after it."""
    return F.initcap(squeeze(name))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_-]", "_")


@pandas_udf(StringType())
def canonical_hash(records: pd.Series) -> pd.Series:
    """SHA-256 of a JSON object with sorted keys and no spaces, without its fetched_at."""
    import hashlib

    def digest(text: str | None) -> str | None:
        if text is None:
            return None
        record = {k: v for k, v in json.loads(text).items() if k != "fetched_at"}
        return hashlib.sha256(json.dumps(record, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    return records.map(digest, na_action="ignore")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def enriched(text: Column, title: Column, facts: Column, first: Column) -> Column:
    """A chunk under a line with its title and, on a document's first chunk, one with its facts; null text is empty."""
    named = F.concat(F.lit("Movie: "), F.trim(F.coalesce(title, F.lit(""))))
    shown = F.when(first & (facts_text(facts) != ""), F.concat(F.lit("Quick facts: "), facts_text(facts)))
    return F.trim(F.concat_ws("\n", named, shown, F.lit(""), F.trim(F.coalesce(text, F.lit("")))))
