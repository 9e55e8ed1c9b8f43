"""Audits of question sets: the rules of a golden set against its documents, and seed answers against records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import long_date, squeeze
from tessella.operators.evaluation import field_matches, minima_report
from tessella.operators.lookup import longest_contained

# How many items of each category a golden set needs, how many in all, and the part of them in dev.
MINIMA = {"single_hop": 15, "multi_hop": 6, "comparative": 4, "temporal": 4, "unanswerable": 8, "ambiguous_adversarial": 3}
LEAST_ITEMS, DEV_PERCENT, MOST_WORDS = 40, 60, 25


def errors(items: DataFrame, documents: DataFrame, minima: dict[str, int] = MINIMA) -> DataFrame:
    """(id, position, error) of everything wrong; id is null for the set as a whole, position for all but evidence.

    Items: id, category, split, answerable and human_verified as texts, gold_answer, document_ids, source_urls, quotes
    (arrays), searched_for. Documents: id, text. Of an item without proper flags nothing more is asked. Rules on the set
    name their category: no_dev:temporal. Quotes are looked for with white space squeezed and case folded (ß as
    ss), in every document of the id.
    """
    checked = _flagged(items)
    own = checked.select("id", F.explode(F.array_compact(F.array(*(F.when(rule, name) for rule, name in _rules(minima))))).alias("error"))
    many = items.groupBy(stripped_id().alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate_id").alias("error"))
    flat = own.unionByName(many).select("id", F.lit(None).cast("int").alias("position"), "error")
    return flat.unionByName(_evidence(checked, documents)).unionByName(_whole(items, minima))


def summary(items: DataFrame, found: DataFrame) -> DataFrame:
    """One row: items, answerable, others, human_verified, errors, structurally_valid and assessment_ready."""
    checked = _flagged(items)
    good = F.col("flags")
    counts = checked.agg(
        F.count("*").alias("items"), F.count_if(good & F.col("is_answerable")).alias("answerable"), F.count_if(good & F.col("is_verified")).alias("human_verified"),
    )
    wrong = found.agg(F.count("*").alias("errors"))
    ready = (F.col("errors") == 0) & (F.col("human_verified") == F.col("items"))
    return counts.crossJoin(wrong).select(  # one row each
        "items", "answerable", (F.col("items") - F.col("answerable")).alias("unanswerable_or_adversarial"), "human_verified", "errors",
        (F.col("errors") == 0).alias("structurally_valid"), ready.alias("assessment_ready"),
    )


def stripped_id() -> Column:
    return F.trim(F.coalesce("id", F.lit("")))


def _flagged(items: DataFrame) -> DataFrame:
    flag = lambda name: F.lower(F.trim(F.coalesce(name, F.lit(""))))
    rows = items.withColumn("is_answerable", flag("answerable") == "true").withColumn("is_verified", flag("human_verified") == "true")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({name: F.coalesce(name, none) for name in ("document_ids", "source_urls", "quotes")})
    return rows.withColumn("flags", flag("answerable").isin("true", "false") & flag("human_verified").isin("true", "false"))


def _rules(minima: dict[str, int]) -> list[tuple[Column, str]]:
    blank = lambda name: F.trim(F.coalesce(name, F.lit(""))) == ""
    n = F.size("document_ids")
    open_, closed = F.col("flags") & F.col("is_answerable"), F.col("flags") & ~F.col("is_answerable")
    return [
        (~F.coalesce(F.col("category").isin(*minima), F.lit(False)), "unsupported_category"),
        (~F.coalesce(F.col("split").isin("dev", "test"), F.lit(False)), "split_must_be_dev_or_test"),
        (~F.col("flags"), "flag_must_be_true_or_false"),
        (open_ & blank("gold_answer"), "answerable_without_answer"),
        (open_ & ((n == 0) | (n != F.size("source_urls"))), "documents_and_urls_must_align"),
        (open_ & (n != F.size("quotes")), "one_quote_per_document"),
        (open_ & ~blank("searched_for"), "answerable_with_searched_for"),
        (open_ & (F.col("category") == "multi_hop") & (F.size(F.array_distinct("document_ids")) < 2), "multi_hop_needs_two_documents"),
        (closed & (n + F.size("source_urls") + F.size("quotes") > 0), "evidence_without_answer"),
        (closed & blank("searched_for"), "searched_for_missing"),
    ]


def _evidence(checked: DataFrame, documents: DataFrame) -> DataFrame:
    least = F.least(F.size("document_ids"), F.size("quotes"))
    zipped = F.arrays_zip(F.slice("document_ids", 1, least).alias("document"), F.slice("quotes", 1, least).alias("quote"))
    pairs = checked.filter("flags AND is_answerable").select("id", F.posexplode(zipped).alias("position", "p"))
    pairs = pairs.select("id", "position", F.col("p.document").alias("document"), F.coalesce("p.quote", F.lit("")).alias("quote"))
    folded = lambda text: F.replace(F.lower(squeeze(F.coalesce(text, F.lit("")))), F.lit("ß"), F.lit("ss"))
    # an inner join first, so that questions may be sent to the documents and no text is shuffled beside its answer
    asked = pairs.select("document", "quote").distinct()
    bodies = documents.select(F.col("id").alias("document"), F.col("text").alias("body"))
    held = bodies.join(asked, "document").select("document", "quote", F.contains(folded("body"), folded("quote")).alias("held"))
    met = held.groupBy("document", "quote").agg(F.max("held").alias("held"))
    words = F.regexp_count("quote", F.lit(r"(?U)\b[\w'-]+\b"))
    wrong = F.when(F.col("held").isNull(), F.array(F.lit("unknown_document"))).otherwise(
        F.array_compact(F.array(F.when(words > MOST_WORDS, "quote_too_long"), F.when(~F.col("held"), "quote_not_found")))
    )
    return pairs.join(met, ["document", "quote"], "left").select("id", "position", F.explode(wrong).alias("error"))


def _whole(items: DataFrame, minima: dict[str, int]) -> DataFrame:
    """What is wrong with the set, from counts of categories and splits."""
    total = items.agg(F.count("*").alias("n"), F.count_if(F.col("split") == "dev").alias("dev"), F.count_if(F.col("split") == "test").alias("test"))
    dev = F.round(F.col("n") * DEV_PERCENT / 100).cast("long")
    sizes = F.array_compact(F.array(F.when(F.col("n") < LEAST_ITEMS, "too_few_items"), F.when((F.col("dev") != dev) | (F.col("test") != F.col("n") - dev), "split_is_not_60_40")))
    found = [total.select(F.explode(sizes).alias("error"))]
    for name, rows, least in [("too_few", items, minima), *((f"no_{s}", items.filter(F.col("split") == s), dict.fromkeys(minima, 1)) for s in ("dev", "test"))]:
        short = minima_report(rows, "category", least).filter("NOT met")
        found.append(short.select(F.concat(F.lit(f"{name}:"), "category").alias("error")))
    missing = [F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("position")]
    return reduce(DataFrame.unionByName, found).select(*missing, "error")


def record_answer(question: Column) -> tuple[Column, Column]:
    """(field that a question asks for, what a record of the columns release_date, directors, writers, runtime, genres,
    top_cast and overview answers). The first phrase that the question holds decides; with none the field is unknown.
    """
    asks = lambda *phrases: reduce(lambda a, b: a | b, (F.contains(F.lower(question), F.lit(p)) for p in phrases))
    names = lambda column: F.array_join(F.coalesce(column, F.array().cast("array<string>")), ", ")
    minutes = F.when(F.coalesce("runtime", F.lit(0)) != 0, F.concat(F.col("runtime").cast("string"), F.lit(" minutes")))
    # Phrases and fields.
    rules = [
        (asks("release date"), "release_date", long_date(F.col("release_date"))), (asks("directed"), "directors", names("directors")),
        (asks("wrote"), "writers", names("writers")), (asks("runtime"), "runtime", minutes), (asks("genre"), "genres", names("genres")),
        (asks("lead stars"), "top_cast", names(F.slice("top_cast", 1, 3))), (asks("overview", "plot summary", " about?"), "overview", F.col("overview")),
    ]
    field, value = F.lit("unknown"), F.lit("")
    for rule, name, answer in reversed(rules):
        field, value = F.when(rule, name).otherwise(field), F.when(rule, F.coalesce(answer, F.lit(""))).otherwise(value)
    return field, value


def seed_audit(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Seed questions (query_id, query, expected) with the record whose title is the longest that they hold: (query_id,
    title, field, answer, status). Records have a title and the columns of `record_answer`; one of each title is used, the
    least by its fields.

    Status: title_not_found, unsupported_question_pattern, gold_not_supported_by_corpus, matches_corpus or mismatch.
    """
    named = longest_contained(questions.select("query_id", "query"), records, "title").join(questions, "query_id")
    columns = ["release_date", "directors", "writers", "runtime", "genres", "top_cast", "overview"]
    one = records.groupBy("title").agg(F.min(F.struct(*columns)).alias("r")).select("title", "r.*")
    field, answer = record_answer(F.col("query"))
    found = F.col("title").isNotNull()
    status = (
        F.when(~found, "title_not_found").when(F.col("field") == "unknown", "unsupported_question_pattern").when(F.col("answer") == "", "gold_not_supported_by_corpus")
        .when(field_matches(F.col("field"), F.col("expected"), F.col("answer")), "matches_corpus").otherwise("mismatch")
    )
    both = named.join(one, "title", "left").withColumn("field", F.when(found, field).otherwise("")).withColumn("answer", F.when(found, answer).otherwise(""))
    return both.select("query_id", "title", "field", "answer", status.alias("status"))
