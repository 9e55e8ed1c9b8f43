import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessella.llm import personal  # noqa: E402


@pytest.fixture
def tables(spark, docs_of, tmp_path):
    plain = [" ".join(f"{w}{i}{j}" for j in range(6) for w in ("tion", "ran", "ber", "ouv")) for i in range(60)]
    texts = plain + [plain[0], plain[1] + " end", " ".join(["mail x@y.org from 10.0.0.1"] * 2), None, "", "passage one two three four five six seven eight nine ten eleven"]
    docs = docs_of(texts).drop("toxicity")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "One two three four, five six seven eight nine ten")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}", texts


def test_each_stage_takes_effect(spark, tables):
    path, texts = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "pieces"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "pieces":
            assert docs.columns == columns
    rows = {r.doc_id: r for r in docs.collect()}
    assert set(rows) == set(range(len(texts))) - {60, 61, 65}
    assert all(r.lossless for r in rows.values())
    clean = " ".join(["mail [EMAIL] from [IP]"] * 2)
    for i, r in rows.items():
        assert r.text_sha256 == hashlib.sha256((clean if i == 62 else texts[i] or "").encode()).hexdigest()
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == set(rows)


def test_empty_tables(spark, tables, tmp_path):
    path, _ = tables
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(f"{path}/none/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{path}/none").count() == 0


def test_redaction_joins_overlapping_spans():
    assert personal.redacted("a 1.2.3.4 b", [(2, 1, 9), (3, 2, 6)]) == "a [IP] b"
