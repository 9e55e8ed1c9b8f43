"""Generations with several writers, contracts and clean-up; streams into tables of one row a key."""

import json
import os
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from tessella.jobs import manifest, publish
from tessella.streaming import querylog, upserts

CONTRACT = {"model": "hash", "size": 64, "instruction": "find "}


def folders(path):
    return sorted(name for name in os.listdir(path) if name.startswith("gen-"))


def test_one_of_several_writers_gets_a_generation(spark, tmp_path):
    base, together = f"file://{tmp_path}/run", Barrier(4)

    def write(number):
        together.wait()
        try:
            return publish.publish({"t": spark.range(number + 1)}, base, "t", after=0)["rows"]["t"]
        except manifest.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        wrote = [n for n in pool.map(write, range(4)) if n]
    assert len(wrote) == 1 and publish.load(spark, base, "t").count() == wrote[0]
    assert len(folders(tmp_path / "run")) == 1  # what the others wrote is gone
    assert os.listdir(tmp_path / "run" / "manifests") == [m for m in os.listdir(tmp_path / "run" / "manifests") if m.endswith(".json")]


def test_claims_by_rename_do_not_replace(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "_is_local", lambda path: False)
    path = f"file://{tmp_path}/0000000001.json"
    manifest.claim(spark, path, {"a": "ä"})
    with pytest.raises(manifest.Conflict):
        manifest.claim(spark, path, {"a": 2})
    assert manifest.content(spark, path) == {"a": "ä"}
    manifest.replace(spark, path, {"a": 3})
    assert manifest.content(spark, path) == {"a": 3} and manifest.numbers(spark, f"file://{tmp_path}") == [1]
    assert not [name for name in os.listdir(tmp_path) if name.endswith(".tmp")]


def test_readers_must_agree_with_the_contract(spark, tmp_path):
    base = f"file://{tmp_path}/run"
    named = publish.publish({"t": spark.range(3)}, base, "t", CONTRACT)
    assert publish.load(spark, base, "t", CONTRACT | {"instruction": "find"}).count() == 3  # outer blanks aside
    with pytest.raises(ValueError, match="differs in model, prefix"):
        publish.load(spark, base, "t", CONTRACT | {"model": "other", "prefix": None})
    with pytest.raises(ValueError, match="not what was published"):
        publish.check_contract(named | {"contract": CONTRACT | {"size": 65}}, None)
    publish.publish({"t": spark.range(1)}, base, "t")
    assert publish.load(spark, base, "t").count() == 1
    with pytest.raises(ValueError, match="no contract"):
        publish.load(spark, base, "t", CONTRACT)


def test_old_generations_go_and_their_numbers_do_not_come_back(spark, tmp_path):
    base = f"file://{tmp_path}/run"
    for n in (1, 2, 3, 4):
        publish.publish({"t": spark.range(n)}, base, "t")
    assert publish.drop_old(spark, base) == [1, 2] and len(folders(tmp_path / "run")) == 2
    assert publish.drop_old(spark, base) == [] and publish.load(spark, base, "t").count() == 4
    with pytest.raises(manifest.Conflict):
        publish.publish({"t": spark.range(9)}, base, "t", after=1)
    with pytest.raises(ValueError):
        publish.drop_old(spark, base, 0)


def test_reports(spark, tmp_path):
    path = f"file://{tmp_path}/report.json"
    report = spark.range(5).agg(F.count("*").alias("rows"), F.collect_list("id").alias("ids"))
    for _ in range(2):
        assert publish.write_report(report, path) == {"rows": 5, "ids": [0, 1, 2, 3, 4]}
    assert json.loads((tmp_path / "report.json").read_text()) == {"rows": 5, "ids": [0, 1, 2, 3, 4]}
    with pytest.raises(ValueError):
        publish.write_report(spark.range(2), path)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, at int, v string")


def state(spark, base):
    return sorted(map(tuple, upserts.table(spark, base).collect()), key=str)


def test_batches_merge_once_and_the_last_row_wins(spark, tmp_path):
    base = f"file://{tmp_path}/state"
    first = rows(spark, ("a", 1, "a1"), ("a", 2, "a2"), ("b", 5, "b5"), (None, None, "n"))
    assert upserts.apply(spark, first, base, ["k"], ["at"], 0, buckets=3)
    assert state(spark, base) == [("a", 2, "a2"), ("b", 5, "b5"), (None, None, "n")]
    second = rows(spark, ("a", 2, "again"), ("b", 4, "late"), ("c", 1, None), (None, 1, "m"))
    assert upserts.apply(spark, second, base, ["k"], ["at"], 1)
    want = [("a", 2, "again"), ("b", 5, "b5"), ("c", 1, None), (None, 1, "m")]
    assert state(spark, base) == want
    before = publish.current(spark, base)
    assert not upserts.apply(spark, rows(spark, ("a", 9, "x")), base, ["k"], ["at"], 1)  # a batch that ran before
    assert not upserts.apply(spark, first, base, ["k"], ["at"], 0)
    assert state(spark, base) == want and publish.current(spark, base) == before
    upserts.apply(spark, rows(spark), base, ["k"], ["at"], 2)  # an empty batch changes no row
    assert state(spark, base) == want
    publish.drop_old(spark, base, 1)
    assert state(spark, base) == want  # buckets that the last generation still names stay


def test_a_batch_cut_off_before_its_claim_is_merged_when_run_again(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/state"
    upserts.apply(spark, rows(spark, ("a", 1, "one")), base, ["k"], ["at"], 0)
    with monkeypatch.context() as lost:
        lost.setattr(publish, "claim_next", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            upserts.apply(spark, rows(spark, ("a", 2, "two")), base, ["k"], ["at"], 1)
    assert state(spark, base) == [("a", 1, "one")] and len(folders(tmp_path / "state")) == 1
    assert upserts.apply(spark, rows(spark, ("a", 2, "two")), base, ["k"], ["at"], 1)
    assert state(spark, base) == [("a", 2, "two")]


def test_a_stream_of_several_files_equals_one_batch(spark, tmp_path):
    base = f"file://{tmp_path}/state"
    for n in range(3):
        rows(spark, *[(str(k), (k * 7 + n * 5) % 11, f"{n}-{k}") for k in range(n, 40 + n)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, at int, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        upserts.start(stream, base, ["k"], ["at"], buckets=5).awaitTermination()
    want = {r.k: r.top for r in spark.read.parquet(f"{tmp_path}/in").groupBy("k").agg(F.max("at").alias("top")).collect()}
    assert {k: at for k, at, _ in state(spark, base)} == want
    assert publish.current(spark, base)["batch"] == 2


def test_repeated_events_within_the_lateness_come_once(spark, tmp_path):
    def add(*events):
        spark.createDataFrame(list(events), "event_id long, ts string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        log = spark.readStream.schema("event_id long, ts string").parquet(f"{tmp_path}/in")
        querylog.once_per_event(log).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    add((1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00"))
    assert run() == [1, 2]
    add((2, "2024-01-01 00:40:00"), (3, "2024-01-01 00:50:00"))  # 2 again, in another batch
    assert run() == [1, 2, 3]
    add((4, "2024-01-01 09:00:00"))
    assert run() == [1, 2, 3, 4]
    add((1, "2024-01-01 09:10:00"), (5, "2024-01-01 01:00:00"))  # 1 is forgotten by now, 5 comes too late
    assert run() == [1, 1, 2, 3, 4]
