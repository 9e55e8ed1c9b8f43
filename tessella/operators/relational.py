"""Joins, de-duplication, unions and grouped lists of the batch stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`."""
    return _first(rows, keys, order, last=True)


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    return _first(rows, keys, order, last=False)


def _first(rows: DataFrame, keys: list[str], order: list[Column], last: bool) -> DataFrame:
    # an aggregate, not a window: rows are reduced before the shuffle, so a hot key costs a row per task
    pick = (F.max_by if last else F.min_by)(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, numbered from 1; Spark cuts each task's rows to k before the shuffle."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("position", number).filter(F.col("position") <= k)


def ordered_values(rows: DataFrame, keys: list[str], value: Column, order: Column) -> DataFrame:
    """Each key's values as an array in a given order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("values"))


def best_by_score(rows: DataFrame, key: str, score: Column, order: Column, value: Column) -> DataFrame:
    """Of each key the value of the highest score, the first by order among equal ones."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct((-score).alias("s"), order.alias("o"))).alias("value"), F.max(score).alias("score"))


def names_in_order(lists: DataFrame, key: str, ids: str, names: DataFrame, missing: str = "id") -> DataFrame:
    """Ids of a list column replaced by names, in the list's order; an unknown id stands for itself."""
    each = lists.select(key, F.posexplode(ids).alias("pos", "id"))
    found = each.join(names.select(F.col("id"), "name"), "id", "left")
    return ordered_values(found, [key], F.coalesce("name", F.col(missing).cast("string")), F.col("pos"))


def known_text(value: Column, fallback: Column) -> Column:
    """`value` unless null or empty, as a record's empty fields do not override."""
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def run_merge(parts: list[DataFrame], key: str) -> DataFrame:
    """Runs one after the other; of rows with one key the last run's stays. Columns that a run lacks are null.

    A null key raises, as it cannot be merged.
    """
    numbered = [p.withColumn("_run", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    rows = rows.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a row has no {key}"))).otherwise(F.col(key)))
    return last_wins(rows, [key], [F.col("_run"), F.xxhash64(*[c for c in rows.columns if c != "_run"])]).drop("_run")


def other_titles(titles: DataFrame, key: str, title: str, own: list[str], most: int = 50) -> DataFrame:
    """Each key's distinct titles other than its own, sorted, the first `most`."""
    sets = titles.groupBy(key).agg(F.collect_set(title).alias("all"), F.array(*(F.first(c) for c in own)).alias("own"))
    return sets.select(key, F.slice(F.array_sort(F.array_except("all", "own")), 1, most).alias("titles"))


def fresh(cache: DataFrame, now: Column, hours: int) -> DataFrame:
    """Cached rows that can be used: matched ones with a date for ever, others while younger than so many hours."""
    lasting = (F.col("status") == "matched") & (F.coalesce("release_date", F.lit("")) != "")
    return cache.filter(lasting | (F.col("fetched_at") > now - F.expr(f"INTERVAL {hours} HOURS")))


def unfinished(seeds: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Seeds that no run has completed."""
    return seeds.join(state.filter("status = 'completed'").select(key), key, "left_anti")


def text_catalog(catalog: DataFrame, texts: DataFrame, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """Catalog rows (slug) with their text (slug, text), and (slug, reason) of those with none or too short a one."""
    joined = catalog.join(texts, "slug", "left")
    reason = F.when(F.col("text").isNull(), "missing_text").when(F.char_length(F.trim("text")) < least, "text_too_short")
    marked = joined.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").select("slug", "reason")
