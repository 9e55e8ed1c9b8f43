"""Conversations as tables: windows of turns, references to what was said, query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that refer back to what was talked about.
REFERENCE = r"\b(it|(this|that|the)\s+(movie|film))\b"


def last_turns(turns: DataFrame, most: int = 8, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """The last turns of each conversation, numbered from the oldest kept."""
    recent = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = turns.filter(F.col("role").isin(*roles)).withColumn("_back", recent).filter(F.col("_back") <= most).drop("_back")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


def with_reference(turns: DataFrame) -> DataFrame:
    """User turns with a word that refers back, and the latest assistant turn before them."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(before)
    return turns.withColumn("answer_turn", said).filter((F.col("role") == "user") & F.lower("text").rlike(REFERENCE))


def log_decision(status: Column, kind: Column) -> Column:
    """error, refused or answered."""
    return F.when(status >= 400, "error").when(kind == "refusal", "refused").otherwise("answered")


def triage(decision: Column, stage: Column, selected: Column) -> Column:
    """The review bucket of a logged query; one that only a second stage or a fused search answered is a recovered miss."""
    recovered = F.coalesce(stage == "escalation", F.lit(False)) | F.coalesce(selected == "multi_query_hyde_rrf", F.lit(False))
    return F.when(decision == "error", "system_error").when(decision == "refused", "needs_review").when(recovered, "recall_miss_recovered").otherwise("answered")


# A follow-up without a subject, and follow-ups that ask for one field, each with the question it stands for.
BARE_FOLLOWUP = r"(?i)^\s*((please\s+)?(explain|tell\s+me)\s+more|more\s+(details|information|info)|what\s+else)\s*[?.!]*\s*$"
FIELD_FOLLOWUP = r"(?i)^\s*(?:and\s+)?(?:what\s+about\s+)?(?:its|the)\s+(director|cast|actors?|writers?|rating|runtime)\s*[?.!]*\s*$"
FIELD_QUESTIONS = (("^director$", "Who directed "), ("^(cast|actors?)$", "Who is in "), ("^writers?$", "Who wrote "))


def resolved_references(turns: DataFrame) -> DataFrame:
    """User turns (conv_id, turn, role, text, titles) with `referenced_title` and `rewritten`, both null where nothing is
    resolved.

    titles has the source titles of an assistant's turn. The title is that of the latest assistant turn before with any,
    if it has just one; a bare follow-up asks for more about it, a field follow-up for the field, and elsewhere words
    that refer back are replaced by it. Null texts and conversations without sources resolve to nothing.
    """
    named = F.array_distinct(F.filter(F.transform("titles", lambda t: F.trim(t)), lambda t: t != ""))
    cited = turns.withColumn("_t", F.when((F.col("role") == "assistant") & (F.size(named) > 0), named))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = cited.withColumn("_t", F.last("_t", ignorenulls=True).over(before)).filter("role = 'user'")
    title = F.when(F.size("_t") == 1, F.get("_t", F.lit(0)))
    field = F.lower(F.regexp_extract("text", FIELD_FOLLOWUP, 1))
    question = F.concat(F.lit("What is the "), field, F.lit(" of "), title, F.lit("?"))
    for pattern, words in reversed(FIELD_QUESTIONS):
        question = F.when(field.rlike(pattern), F.concat(F.lit(words), title, F.lit("?"))).otherwise(question)
    plain = F.regexp_replace(title, r"([\\$])", r"\\$1")  # a title is no replacement pattern
    rewritten = (
        F.when(F.col("text").rlike(BARE_FOLLOWUP), F.concat(F.lit("Tell me more about "), title))
        .when(field != "", question)
        .when(F.lower("text").rlike(REFERENCE), F.regexp_replace(F.trim("text"), F.lit(f"(?i){REFERENCE}"), plain))
    )
    out = asked.withColumn("rewritten", rewritten)
    return out.withColumn("referenced_title", F.when(F.col("rewritten").isNotNull(), title)).drop("_t")


def recent(log: DataFrame, order: list[Column], limit: int, condition: Column | None = None) -> DataFrame:
    rows = log.filter(condition) if condition is not None else log
    return rows.orderBy(*order).limit(limit)
