"""Filters, rankings, lists and groups over a catalog table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import all_of, display_name, normalize

RANK_LIMIT, LIST_LIMIT, VOTE_FLOOR = 10, 50, 1000


@dataclass(frozen=True)
class Filters:
    """A conjunction of optional conditions; a null value fails every condition that is set."""

    equal: dict[str, object] = field(default_factory=dict)
    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)
    months: dict[str, list[int]] = field(default_factory=dict)
    known: tuple[str, ...] = ()
    member: dict[str, str] = field(default_factory=dict)
    terms: tuple[str, ...] = ()
    term_columns: tuple[str, ...] = ()

    def condition(self) -> Column:
        """A plain column expression, so that the scan gets what it can evaluate."""
        parts = [F.col(c) == v for c, v in self.equal.items()]
        parts += [F.col(c) >= v for c, v in self.least.items()]
        parts += [F.col(c) <= v for c, v in self.most.items()]
        parts += [F.month(c).isin(ms) for c, ms in self.months.items()]
        parts += [F.col(c).isNotNull() for c in self.known]
        parts += [F.array_contains(F.transform(c, lambda g: normalize(g)), normalize(F.lit(v))) for c, v in self.member.items()]
        haystack = normalize(F.concat_ws(" ", *self.term_columns)) if self.terms else None
        parts += [haystack.contains(t) for t in self.terms]
        return all_of(parts)


def name_has_tokens(names: Column, terms: list[str]) -> Column:
    """Whether one name has all the terms as whole tokens."""
    return F.exists(names, lambda n: F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(F.split(normalize(n), " "), t)))


def window_status(day: Column, first: str, last: str) -> Column:
    """kept within both ends, else why not."""
    return F.when(day.isNull(), "missing_release_date").when(day.between(first, last), "kept").otherwise("outside_release_window")


def ranked(rows: DataFrame, value: str, title: str, key: str, descending: bool = True, limit: int = RANK_LIMIT) -> DataFrame:
    """The first rows by value, then lower-cased title, then key; rows without a value are left out."""
    order = [F.desc(value) if descending else F.asc(value), F.lower(title), F.col(key)]
    top = rows.filter(F.col(value).isNotNull()).orderBy(*order).limit(limit)
    return top.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)))  # over `limit` rows


def rated(rows: DataFrame, rating: str, votes: str, title: str, key: str, least_votes: int | None = None, limit: int = RANK_LIMIT) -> DataFrame:
    """The best rated rows among those with enough votes: VOTE_FLOOR of them where no number is asked for; unknown votes are not enough."""
    floor = VOTE_FLOOR if least_votes is None else least_votes
    return ranked(rows.filter(F.col(votes) >= floor), rating, title, key, limit=limit)


def no_matches_text(rows: DataFrame, year: str, person: str | None = None, narrowed: bool = False) -> DataFrame:
    """One line (answer) for filters that no row of a catalog meets. With a person, it names the catalog's year if that is
    one; years that are null or 0 do not count.
    """
    # The sentences.
    if not person:
        return rows.agg(F.lit("No movies matched those structured filters.").alias("answer"))
    known = F.nullif(F.col(year), F.lit(0))
    one = F.min(known) == F.max(known)
    place = F.when(one, F.concat(F.lit("this "), F.min(known).cast("string"), F.lit(" dataset."))).otherwise("this dataset.")
    words = ("No movies matched all requested filters for ", " in ") if narrowed else ("No movies featuring ", " were found in ")
    return rows.agg(F.concat(F.lit(words[0]), display_name(F.lit(person)), F.lit(words[1]), place).alias("answer"))


def listed(rows: DataFrame, key: str, limit: int = LIST_LIMIT) -> DataFrame:
    """The first rows by key, with the number of all rows and whether some are left out."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(key).limit(limit).withColumn("ordinal", F.row_number().over(Window.orderBy(key)))
    return top.join(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)  # one row


def group_counts(rows: DataFrame, group: Column, kind: str, missing: str) -> DataFrame:
    value = F.coalesce(group.cast("string"), F.lit(missing))
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")


def top_groups_text(groups: DataFrame, limit: int = 8) -> DataFrame:
    """The largest groups in one line: "value: n; ..."."""
    top = groups.orderBy(F.desc("n"), "value").limit(limit)
    line = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value", "n"))), lambda g: F.concat(g["value"], F.lit(": "), g["n"].cast("string")))
    return top.agg(F.array_join(line, "; ").alias("answer"))
