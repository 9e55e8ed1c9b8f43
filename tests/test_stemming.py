import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.functions import stemming
from tessella.jobs.queries import QUERIES
from tessella.operators import index

# The examples that the published rules give, worked through all steps by hand.
EXAMPLES = """
caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll by by a a is is
""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True)))
def test_published_rules(word, want):
    assert stemming.stem(word) == want


def test_other_words_stay():
    assert [stemming.stem(w) for w in ("", "xy", "b2b", "straße", "running2")] == ["", "xy", "b2b", "straße", "running2"]
    assert stemming.stem(stemming.fold("élections")) == "elect" and [stemming.measure(w) for w in ("tree", "trouble", "oaten", "syzygy")] == [0, 1, 2, 2]


def test_dictionary_has_each_term_once(spark):
    rows = spark.createDataFrame([("running",), ("running",), ("runs",), ("ÉTÉS".lower(),), (None,)], "term string")
    got = {r.term: r.stem for r in stemming.term_dictionary(rows).collect()}
    assert got == {"running": "run", "runs": "run", "étés": "et", None: None}


def test_stemmed_postings_fold_forms_together(spark):
    docs = spark.createDataFrame([(1, "Runs, running! A Café."), (2, "café's"), (3, None), (4, "")], "id long, text string")
    got = {(r.id, r.term): (r.tf, r.len) for r in index.stemmed_postings(docs, "id").collect()}
    assert got == {(1, "run"): (2, 4), (1, "a"): (1, 4), (1, "cafe"): (1, 4), (2, "cafe"): (1, 2), (2, "s"): (1, 2)}


def test_query_like_brute_force(spark, sf_dir):
    def words(text):
        return [stemming.stem(stemming.fold(w)) for w in re.findall(r"[^\W_]+", (text or "").lower())]

    docs = {r.doc_id: Counter(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    holders = defaultdict(list)
    for doc, terms in docs.items():
        for t in terms:
            holders[t].append(doc)
    mean = sum(c.total() for c in docs.values()) / len(docs)
    got = defaultdict(list)
    for r in QUERIES["bm25_stemmed_topk"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter(F.col("item_id").isNotNull()).collect()
    for item in items:
        scores = defaultdict(float)
        for t in set(words(item.text)):
            for doc in holders[t]:
                idf = max(math.log((len(docs) - len(holders[t]) + 0.5) / (len(holders[t]) + 0.5)), 1e-6)
                tf = docs[doc][t]
                scores[doc] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * docs[doc].total() / mean))
        best = sorted(((-round(s, 9), d) for d, s in scores.items()))[:20]
        assert [s for _, s in got[item.item_id]] == pytest.approx([-s for s, _ in best], abs=2e-3)


def test_stored_rows_follow_the_queries_words(spark, sf_dir, tmp_path):
    """Copies of the documents add nothing to what is stored beside them."""
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.join(spark.range(3)).withColumn("doc_id", F.col("doc_id") * 3 + F.col("id")).drop("id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")

    def stored(folder):
        before = set(root.iterdir())
        QUERIES["bm25_stemmed_topk"](spark, folder).collect()
        return sum(pq.read_metadata(p).num_rows for new in set(root.iterdir()) - before for p in new.rglob("*.parquet"))

    assert stored(str(tmp_path)) == stored(sf_dir)
