"""Tables published by generation: written beside what is there, then named by a manifest that only one writer can claim."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.jobs import manifest


def current(spark: SparkSession, base: str) -> dict | None:
    """The manifest of the last published generation, None before the first."""
    numbers = manifest.numbers(spark, _manifests(base))
    return manifest.content(spark, _manifest(base, numbers[-1])) if numbers else None


def publish(tables: dict[str, DataFrame], base: str, must_have_rows: str, contract: dict | None = None, after: int | None = None) -> dict:
    """Write the tables to folders of their own, then claim the next generation for them by a manifest.

    Readers see the old generation or the whole new one. Of writers that started from the same generation (the current one,
    or `after`, which a caller names whose tables were made from it) one succeeds; the others get Conflict, and what they
    wrote goes. With no rows in the named table nothing is published. The contract is what readers must agree with: the
    model, its size, prefixes and the like.
    """
    spark = next(iter(tables.values())).sparkSession
    if after is None:
        before = current(spark, base)
        after = before["generation"] if before else 0
    folder = f"{base.rstrip('/')}/gen-{after + 1}-{uuid.uuid4().hex}"
    try:
        paths = {name: f"{folder}/{name}" for name in tables}
        for name, table in tables.items():
            table.write.parquet(paths[name])
        counts = {name: spark.read.parquet(path).count() for name, path in paths.items()}
        if not counts[must_have_rows]:
            raise ValueError(f"{must_have_rows} has no rows; generation {after + 1} is not published")
        named = {"generation": after + 1, "folder": folder, "tables": paths, "rows": counts, "contract": contract, "contract_hash": _digest(contract)}
        return claim_next(spark, base, named)
    except BaseException:
        manifest.remove(spark, folder)
        raise


def claim_next(spark: SparkSession, base: str, named: dict) -> dict:
    """Make a manifest the one of its generation; Conflict where another writer has."""
    manifest.claim(spark, _manifest(base, named["generation"]), named)
    return named


def load(spark: SparkSession, base: str, table: str, contract: dict | None = None) -> DataFrame:
    """A table of the current generation, once the reader's contract, if it has one, is found to be that of the manifest."""
    named = current(spark, base)
    if named is None:
        raise ValueError(f"nothing is published in {base}")
    check_contract(named, contract)
    return spark.read.parquet(named["tables"][table])


def check_contract(named: dict, contract: dict | None) -> None:
    """Raise where a reader's contract is not the manifest's, naming what differs; texts may differ in outer blanks."""
    kept = named.get("contract")
    if named.get("contract_hash") != _digest(kept):
        raise ValueError(f"the contract of generation {named['generation']} is not what was published")
    if contract is None:
        return
    if kept is None:
        raise ValueError(f"generation {named['generation']} has no contract")
    if named["contract_hash"] != _digest(contract):
        mine, theirs = _trimmed(contract), _trimmed(kept)
        wrong = sorted(k for k in mine.keys() | theirs.keys() if k not in mine or k not in theirs or mine[k] != theirs[k])
        raise ValueError(f"generation {named['generation']} differs in {', '.join(wrong)}")


def drop_old(spark: SparkSession, base: str, keep: int = 2) -> list[int]:
    """Delete the folders of all generations but the newest `keep`, for readers that still hold the one before; the numbers dropped.

    Manifests stay: a writer that started long ago must not find its generation free. A folder that is gone is passed over,
    and one that a later manifest names (an upsert's bucket) stays.
    """
    if keep < 1:
        raise ValueError("the current generation stays")
    known = [manifest.content(spark, _manifest(base, n)) for n in manifest.numbers(spark, _manifests(base))]
    wanted = {path for named in known[-keep:] for path in named["tables"].values()}
    dropped = []
    for named in known[:-keep]:
        gone = [manifest.remove(spark, path) for path in named["tables"].values() if path not in wanted]
        if any(gone):
            dropped.append(named["generation"])
        if not any(path.startswith(named["folder"] + "/") for path in wanted):
            manifest.remove(spark, named["folder"])
    return dropped


def write_report(report: DataFrame, path: str) -> dict:
    """A report of one row as a JSON file, put there whole."""
    rows = report.select(F.to_json(F.struct(*report.columns)).alias("json")).take(2)
    if len(rows) != 1:
        raise ValueError("a report has one row")
    found = json.loads(rows[0]["json"])
    manifest.replace(report.sparkSession, path, found)
    return found


def _manifests(base: str) -> str:
    return f"{base.rstrip('/')}/manifests"


def _manifest(base: str, generation: int) -> str:
    return f"{_manifests(base)}/{generation:010d}.json"


def _trimmed(contract: dict) -> dict:
    return {k: v.strip() if isinstance(v, str) else v for k, v in contract.items()}


def _digest(contract: dict | None) -> str | None:
    return None if contract is None else hashlib.sha256(json.dumps(_trimmed(contract), sort_keys=True).encode()).hexdigest()


def write_flat_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """CSV of fixed columns, nested ones as JSON."""
    kinds = dict(rows.dtypes)
    nested = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c) for c in columns]
    rows.select(*nested).write.mode("overwrite").option("header", True).csv(path)


def append_log(records: DataFrame, path: str) -> None:
    """Append query-log rows as JSON lines; id, created_at and review_status get defaults where a record has none."""
    defaults = {"id": F.expr("uuid()"), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "review_status": F.lit("unreviewed")}
    for name, value in defaults.items():
        records = records.withColumn(name, F.coalesce(name, value) if name in records.columns else value)
    records.write.mode("append").json(path)


def write_postings(postings: DataFrame, table: str, buckets: int = 64) -> None:
    """Postings as a table bucketed and sorted by term, so that probing a few terms reads few files and joins without a shuffle."""
    postings.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)
