"""Evidence for answers and the checks on what comes back; the model itself is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import citation_numbers

LEAST_RERANK = -4.5


def evidence(results: DataFrame, group: str = "query_id") -> DataFrame:
    """(group, context, sources): results as numbered blocks in rank order."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.groupBy(group).agg(F.array_join(F.transform(rows, lambda r: r["block"]), "\n\n").alias("context"), F.count("*").cast("int").alias("sources"))


def refusal(found: Column, best_rerank: Column) -> Column:
    """Why no answer is asked for: nothing found, or nothing near enough; a missing score passes."""
    return F.when(found == 0, "out_of_scope").when(F.coalesce(best_rerank, F.lit(0.0)) < LEAST_RERANK, "not_in_sources")


def citations_valid(answer: Column, sources: Column) -> Column:
    """Whether an answer cites, and only sources that there are."""
    numbers = citation_numbers(answer)
    return (F.size(numbers) > 0) & F.forall(numbers, lambda n: (n >= 1) & (n <= sources))


def cited(sources: DataFrame, number: str, answer: str) -> DataFrame:
    """The sources that an answer cites; all of them if it cites none."""
    numbers = citation_numbers(F.col(answer))
    return sources.filter((F.size(numbers) == 0) | F.array_contains(numbers, F.col(number)))
