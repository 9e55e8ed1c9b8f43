"""Retrieval metrics per item and in groups, intervals by resampling, and rules for question sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import plain_words, spoken_minutes, squeeze


def item_metrics(runs: DataFrame, gold: str = "gold", found: str = "found") -> DataFrame:
    """recall_5, recall_20, rr and ndcg_10 of ranked arrays against gold arrays; null without gold."""
    g, r = F.array_distinct(gold), F.array_distinct(found)
    n = F.size(g)

    def recall(k: int) -> Column:
        return F.size(F.array_intersect(g, F.slice(r, 1, k))) / n

    hits = F.transform(r, lambda x, i: F.when(F.array_contains(g, x), i + 1))
    first = F.array_min(F.filter(hits, lambda x: x.isNotNull()))
    gain = F.aggregate(F.filter(F.slice(hits, 1, 10), lambda x: x.isNotNull()), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(10))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    some = n > 0
    return runs.withColumns({
        "recall_5": F.when(some, recall(5)), "recall_20": F.when(some, recall(20)),
        "rr": F.when(some, F.coalesce(1.0 / first, F.lit(0.0))), "ndcg_10": F.when(some, gain / F.when(some, ideal)),
    })


def support_metrics(runs: DataFrame, gold: str = "gold", found: str = "found", answerable: str = "answerable", refused: str = "refused") -> DataFrame:
    """answer_support_5 (all gold in the first five), citation_valid_5 (any), over_refusal of answerable items, and
    correct_refusal of the others; each is null for the other kind, the first two also without gold.
    """
    g = F.array_distinct(gold)
    both = F.size(F.array_intersect(g, F.slice(F.array_distinct(found), 1, 5)))
    asked, some = F.col(answerable), F.col(answerable) & (F.size(g) > 0)
    no = F.col(refused).cast("double")
    return runs.withColumns({
        "answer_support_5": F.when(some, (both == F.size(g)).cast("double")), "citation_valid_5": F.when(some, (both > 0).cast("double")),
        "correct_refusal": F.when(~asked, no), "over_refusal": F.when(asked, no),
    })


def mean_present(value: str) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def grouped_metrics(items: DataFrame, group: str, split: str, metrics: list[str]) -> DataFrame:
    """Means by group over all items and by split, in one pass over grouping sets."""
    rows = items.groupingSets([[F.col(group)], [F.col(group), F.col(split)]], F.col(group), F.col(split)).agg(
        F.count("*").alias("n"), *(mean_present(m).alias(m) for m in metrics), F.grouping(split).alias("_all")
    )
    return rows.withColumn(split, F.when(F.col("_all") == 1, "all").otherwise(F.col(split))).drop("_all")


def percentiles(rows: DataFrame, value: str, shares: list[float], group: list[str]) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return rows.groupBy(*group).agg(*(F.percentile(value, F.lit(p)).alias(f"p{round(100 * p)}") for p in shares))


def _poisson(keys: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Appearances of each row in each resample: Poisson numbers of mean 1, fixed by the row's key and the seed."""
    x = keys.astype(np.uint64)[:, None] ^ (np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(steps, share, "right")


def _resampled(rows: DataFrame, key: Column, top: str, bottom: Column, group: str, samples: int, seed: int) -> DataFrame:
    """(group, low, high): the middle 95 per cent of sum(top) / sum(bottom) over resamples, drawn by key.

    A resample of n rows gives each row a number of appearances near a Poisson one; each task draws its rows' and sums
    them, so what is shuffled is a row per task, group and block of resamples, whatever the number of rows.
    """
    block = 500

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.dropna(subset=["_top", "_bottom"]).groupby(group):
                values, weights, keys = part["_top"].to_numpy(float), part["_bottom"].to_numpy(float), part["_row"].to_numpy().view(np.uint64)
                own = sums.setdefault(name, np.zeros((samples, 2)))
                for start in range(0, len(values), 128):
                    times = _poisson(keys[start : start + 128], samples, seed)
                    own[:, 0] += values[start : start + 128] @ times
                    own[:, 1] += weights[start : start + 128] @ times
        for name, own in sums.items():
            for start in range(0, samples, block):
                part = own[start : start + block]
                yield pd.DataFrame({group: [name], "block": [start], "sums": [part[:, 0]], "counts": [part[:, 1]]})

    kind = dict(rows.dtypes)[group]
    keyed = rows.select(group, F.col(top).alias("_top"), bottom.alias("_bottom"), key.alias("_row"))
    drawn = keyed.mapInPandas(draw, f"{group} {kind}, block int, sums array<double>, counts array<double>")
    each = drawn.select(group, "block", F.posexplode(F.arrays_zip("sums", "counts")).alias("i", "x"))
    means = each.groupBy(group, "block", "i").agg(F.try_divide(F.sum("x.sums"), F.sum("x.counts")).alias("m"))
    return means.groupBy(group).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def bootstrap_means(rows: DataFrame, value: str, group: str, samples: int = 5000, seed: int = 7411) -> DataFrame:
    """(group, mean, low, high): the middle 95 per cent of means of resamples; rows draw by all their columns."""
    bounds = _resampled(rows, F.xxhash64(*rows.columns), value, F.lit(1.0), group, samples, seed)
    return rows.groupBy(group).agg(F.avg(value).alias("mean")).join(bounds, group)


def bootstrap_rates(rows: DataFrame, key: str, top: str, bottom: str, group: str, samples: int = 5000, seed: int = 7411) -> DataFrame:
    """(group, n, rate, low, high) of sum(top) / sum(bottom), items drawn whole.

    An item appears as often in each group of a resample, so that groups can be compared. Rows with a null are left out.
    """
    some = rows.filter(F.col(top).isNotNull() & F.col(bottom).isNotNull())
    bounds = _resampled(some, F.xxhash64(key), top, F.col(bottom).cast("double"), group, samples, seed)
    rates = some.groupBy(group).agg(F.count("*").alias("n"), F.try_divide(F.sum(top), F.sum(bottom)).alias("rate"))
    return rates.join(bounds, group)


def bootstrap_pairs(items: DataFrame, key: str, baseline: str, metric: str, first: str, second: str, samples: int = 5000, seed: int = 7411) -> DataFrame:
    """One row (first, second, n, delta, low, high): the mean of second minus first over the items that both have.

    Items are drawn by key, both sides of one together. No pairs: no row.
    """
    pairs = paired_deltas(items, key, baseline, metric, first, second).withColumn("_all", F.lit(True))
    bounds = _resampled(pairs, F.xxhash64(key), "delta", F.lit(1.0), "_all", samples, seed)
    whole = pairs.groupBy("_all").agg(F.count("*").alias("n"), F.avg("delta").alias("delta")).join(bounds, "_all")
    return whole.select(F.lit(first).alias("first"), F.lit(second).alias("second"), "n", "delta", "low", "high")


def baselines(items: DataFrame, lists: dict[str, DataFrame | None], gates: dict[str, float], document: str, k: int = 20) -> DataFrame:
    """A row per item (query_id, answerable, gold) and baseline: found (k distinct documents in order), top, status, refused,
    and the item and support metrics.

    Lists are (query_id, document, rank, score); None is a baseline that refuses every item. Status is refused for that,
    no_results without rows, low_confidence where the first row's score is missing or under the baseline's gate, else ok.
    All lists are grouped in one shuffle, and items meet them once, by item and baseline.
    """
    rows = [frame.select("query_id", F.col(document).alias("document"), "rank", F.col("score").cast("double").alias("score"), F.lit(name).alias("baseline")) for name, frame in lists.items() if frame is not None]
    first = F.min(F.struct("rank", "document", "score"))
    each = reduce(DataFrame.unionByName, rows).groupBy("query_id", "baseline", "document").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))), lambda r: r["document"])
    runs = each.groupBy("query_id", "baseline").agg(F.slice(ordered, 1, k).alias("found"), first["score"].alias("top"))
    names = F.explode(F.array(*map(F.lit, lists))).alias("baseline")
    kind = runs.schema["found"].dataType
    asked = items.select("query_id", "answerable", "gold", names).join(runs, ["query_id", "baseline"], "left").withColumn("found", F.coalesce("found", F.array().cast(kind)))
    closed = F.col("baseline").isin([n for n, frame in lists.items() if frame is None])
    low = reduce(lambda a, b: a | b, [(F.col("baseline") == n) & (F.coalesce("top", F.lit(0.0)) < gate) for n, gate in gates.items()], F.lit(False))
    status = F.when(closed, "refused").when(F.size("found") == 0, "no_results").when(low, "low_confidence").otherwise("ok")
    judged = asked.withColumn("status", status).withColumn("refused", F.col("status") != "ok")
    return support_metrics(item_metrics(judged))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def minima_report(rows: DataFrame, group: str, least: dict[str, int]) -> DataFrame:
    """(group, n, least, met) for each group with a minimum, also those without rows."""
    wanted = rows.sparkSession.createDataFrame(list(least.items()), f"{group} string, least long")
    counts = rows.groupBy(F.col(group).cast("string").alias(group)).agg(F.count("*").alias("n"))
    report = F.broadcast(wanted).join(counts, group, "left")
    return report.select(group, F.coalesce("n", F.lit(0)).alias("n"), "least", (F.coalesce("n", F.lit(0)) >= F.col("least")).alias("met"))


def failure_label(answerable: Column, refused: Column, recall: Column, first_hit: Column) -> Column:
    """What went wrong with an item, null for nothing."""
    return (
        F.when(answerable & refused, "over_refusal")
        .when(~answerable & ~refused, "hallucination_risk")
        .when(answerable & (recall == 0), "retrieval_miss")
        .when(answerable & (first_hit > 1), "rank_failure")
    )


def quote_support(questions: DataFrame, documents: DataFrame, ids: str = "document_ids", quotes: str = "quotes") -> DataFrame:
    """(id, position, status) of each packed document id with its quote: missing_document, quote_not_found or supported.

    White space is squeezed on both sides before the quote is looked for; documents shuffle by id, not by quote.
    """
    pairs = questions.select("id", F.posexplode(F.arrays_zip(F.col(ids).alias("document"), F.col(quotes).alias("quote"))).alias("position", "p"))
    each = pairs.select("id", "position", F.col("p.document").alias("document"), F.col("p.quote").alias("quote"))
    found = each.join(documents.select(F.col("id").alias("document"), F.col("text").alias("body")), "document", "left")
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    status = F.when(F.col("body").isNull(), "missing_document").when(F.contains(squeezed(F.col("body")), squeezed(F.coalesce("quote", F.lit("")))), "supported")
    return found.select("id", "position", status.alias("status")).withColumn("status", F.coalesce("status", F.lit("quote_not_found")))


def paired_deltas(items: DataFrame, key: str, baseline: str, metric: str, first: str, second: str) -> DataFrame:
    """(key, delta) of items that both baselines have: second minus first; one grouping instead of a self-join."""
    one = lambda name: F.max(F.when(F.col(baseline) == name, F.col(metric)))
    both = items.filter(F.col(baseline).isin(first, second)).groupBy(key).agg(one(first).alias("a"), one(second).alias("b"))
    return both.filter("a IS NOT NULL AND b IS NOT NULL").select(key, (F.col("b") - F.col("a")).alias("delta"))


def question_errors(questions: DataFrame, most_words: int = 25, banned: str | None = None) -> DataFrame:
    """Questions (id, question, answerable, document_ids, quotes) with an array of what is wrong with each."""
    words = lambda q: F.regexp_count(q, F.lit(r"\b[\w'-]+\b"))
    rules = [
        (F.coalesce(F.trim("question"), F.lit("")) == "", "empty_question"),
        (F.col("answerable") & (F.size("document_ids") == 0), "answerable_without_document"),
        (~F.col("answerable") & (F.size("document_ids") > 0), "unanswerable_with_document"),
        (F.size("document_ids") != F.size("quotes"), "lists_differ_in_length"),
        (F.exists("quotes", lambda q: words(q) > most_words), "quote_too_long"),
    ]
    if banned:
        rules.append((F.col("question").rlike(f"(?i){banned}"), "domain_term"))
    return questions.withColumn("errors", F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules))))


def field_matches(field: Column, expected: Column, canonical: Column) -> Column:
    """Whether an expected answer agrees with a record's value: minutes of a runtime, a date that stands in the answer,
    elsewhere every token of two or more characters. False where either is null or the record's value is empty.
    """
    tokens = F.filter(F.split(plain_words(canonical), " "), lambda t: F.char_length(t) > 1)
    minutes = F.nullif(F.regexp_extract(canonical, r"\d+", 0), F.lit("")).try_cast("int")
    flat = lambda c: F.lower(squeeze(c))
    same = (
        F.when(field == "runtime", F.coalesce(spoken_minutes(expected), F.lit(0)) == minutes)
        .when(field == "release_date", F.contains(flat(expected), flat(canonical)))
        .otherwise((F.size(tokens) > 0) & (F.size(F.array_except(tokens, F.split(plain_words(expected), " "))) == 0))
    )
    return F.coalesce(same & (F.trim(canonical) != "") & expected.isNotNull(), F.lit(False))
