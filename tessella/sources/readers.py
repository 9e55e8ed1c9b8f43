"""Readers of bulk TSV files, JSON lines, question sets and seed lists, with rejected rows beside the good ones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.functions.text import nullable, packed_items


def bulk_tsv(spark: SparkSession, path: str, columns: list[str], partitions: int | None = None) -> DataFrame:
    """A tab-separated file with a header, unquoted; null marks and empty strings are null, fields of any length.

    A gzip file is read by one task: give `partitions` to deal its rows out for what follows.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("maxCharsPerColumn", -1).csv(path)
    rows = rows.select(*(nullable(F.col(c)).alias(c) for c in columns))
    return rows.repartition(partitions) if partitions else rows


def catalog_json(spark: SparkSession, path: str, schema: StructType, key: str, title: str) -> DataFrame:
    """Strict JSON lines: a malformed line fails the read; rows without key or title are left out."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.filter((F.coalesce(key, F.lit("")) != "") & (F.coalesce(title, F.lit("")) != ""))


def lenient_json(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines that are objects; and (line, reason) of the others, blank lines aside."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    value = F.try_parse_json("value")
    reason = F.when(value.isNull(), "invalid_json").when(~F.trim("value").startswith("{"), "document_must_be_an_object")
    routed = lines.withColumn("reason", reason)
    good = routed.filter("reason IS NULL").select(F.from_json("value", schema).alias("row")).select("row.*")
    return good, routed.filter("reason IS NOT NULL").select(F.col("value").alias("line"), "reason")


def question_set(spark: SparkSession, path: str, lists: list[str], flags: list[str]) -> DataFrame:
    """A CSV of questions with packed lists and true/false strings decoded, and the byte-order mark dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.select(*(F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in rows.columns))
    for c in lists:
        rows = rows.withColumn(c, packed_items(F.coalesce(c, F.lit(""))))
    for c in flags:
        rows = rows.withColumn(c, F.lower(F.trim(c)) == "true")
    return rows


def seed_urls(spark: SparkSession, path: str, host: str, pattern: str, most: int | None = None) -> DataFrame:
    """(id, url) of a list of addresses: comments and blank lines skipped, other hosts fail, the first of an id stays."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"), F.monotonically_increasing_id().alias("seq"))
    lines = lines.filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    ident = F.regexp_extract(F.try_parse_url("url", F.lit("PATH")), pattern, 1)
    right = F.coalesce(F.regexp_replace(F.try_parse_url("url", F.lit("HOST")), "^www[.]", "") == host, F.lit(False)) & (ident != "")
    checked = lines.withColumn("id", F.when(right, ident).otherwise(F.raise_error(F.concat(F.lit("not a title address: "), F.col("url")))))
    first = checked.groupBy("id").agg(F.min("seq").alias("seq")).orderBy("seq")
    return (first.limit(most) if most else first).select("id", F.concat(F.lit(f"https://www.{host}/title/"), "id", F.lit("/")).alias("url"))


def alias_rows(spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in aliases.items() if k and v], "alias string, target string")


def alias_file(spark: SparkSession, path: str) -> DataFrame:
    """(alias, target) of a JSON object of texts, whole or under "aliases"; other values and blank texts are left out.

    A missing file, and one that is no such object, has no rows.
    """
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "alias string, target string")
    found = whole.select(F.try_parse_json("value").alias("v")).select(F.coalesce(F.try_variant_get("v", "$.aliases", "variant"), "v").alias("v"))
    each = found.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("alias", "v")).filter(F.schema_of_variant("v") == "STRING")
    texts = each.select(F.btrim("alias").alias("alias"), F.btrim(F.try_variant_get("v", "$", "string")).alias("target"))
    return texts.filter("alias <> '' AND target <> ''")
