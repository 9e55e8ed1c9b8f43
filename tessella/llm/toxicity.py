"""Toxicity by compression distance: which zstandard dictionary shortens a text's windows more.

The ordinary dictionary is made of ordinary texts; two others add what toxic texts have oftener, and what they have far
oftener. A window is a word, so that no other word's bytes blur its gain; a worker remembers the gains of words.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import byte_slices, texts_of
from tessella.llm.picking import free_name

WORD = re.compile(r"[^\W\d_]+")
#: At most so many labelled rows of either class are sampled to fit a model, those with the smallest hash of doc_id.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 1500, 3000
#: A window is a word, written once and so many times over; a short one alone is stored raw and shows no gain.
WRITTEN = (1, 3)
#: Distinct windows whose lengths a worker remembers; beyond it it forgets them all and goes on.
MEMO_WINDOWS = 400_000
BASE_WORDS = 1500
#: The least likelihood ratio (G squared) with which a fragment enters the toxic dictionary, whatever the sample's size.
LEAST_RATIO = 25.0
#: Words that a fragment brings along.
WORDS_OF_FRAGMENT = 30
#: So many times as often, at least, toxic texts have such a fragment; and one of the stronger dictionary.
LEAST_LIFT, STRONG_LIFT = 5.0, 30.0
#: Parts of the sample: each is scored by dictionaries of the others, to calibrate scores on texts that they have not seen.
FOLDS = 3
_GAINS = (1, 2, 3, 4)


@dataclass(frozen=True)
class ToxicityModel:
    """The dictionaries' bytes, ordinary, toxic and strongly toxic, and the calibration: features are centred, scaled, weighted, then squashed.

    Without rows of both classes there is nothing to tell apart: weights is empty and every score is `prior`.
    """

    ordinary: bytes
    toxic: bytes
    strong: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float


class _Scorer:
    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.compressors = tuple(self._compressor(d) for d in (model.ordinary, model.toxic, model.strong))
        self.memo: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters.from_level(
            3, strategy=zstandard.STRATEGY_GREEDY, min_match=5, search_log=5, window_log=15, write_content_size=False, write_dict_id=False
        )
        return zstandard.ZstdCompressor(
            compression_params=settings,
            dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        )

    def features(self, text: str) -> np.ndarray:
        """How many bytes each toxic dictionary saves: the best window, the three best, and windows beyond each gain."""
        words = WORD.findall(text.lower()) or [""]
        if len(self.memo) > MEMO_WINDOWS:
            self.memo.clear()
        saved = np.array([self.memo.get(w) or self._saved(w) for w in words], dtype=float)
        out = [np.log(len(saved))]
        for gains in saved.T:
            top = np.sort(np.partition(gains, -3)[-3:])[::-1] if len(gains) > 3 else np.sort(gains)[::-1]
            out += [top[0], top.sum() / 3]
            for gain in _GAINS:
                beyond = float((gains > gain).sum())
                out += [beyond / len(gains), np.log1p(beyond)]
        return np.array(out)

    def _saved(self, word: str) -> tuple[int, ...]:
        """Bytes that either toxic dictionary saves on a window, for each way of writing it."""
        out: list[int] = []
        ordinary, *others = self.compressors
        for times in WRITTEN:
            window = (f" {word}" * times + " ").encode()
            size = len(ordinary.compress(window))
            out += [size - len(other.compress(window)) for other in others]
        self.memo[word] = found = tuple(out)
        return found

    def score(self, features: np.ndarray) -> float:
        model = self.model
        x = np.append((features - np.array(model.centre)) / np.array(model.scale), 1.0)
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -40, 40))))


def _unlike(texts: list[str]) -> list[str]:
    """The texts without copies and most near copies: one for each pair of least hashes of three words."""
    first: dict[tuple[int, ...], str] = {}
    for text in texts:
        words = WORD.findall(text.lower())
        runs = {" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))}
        first.setdefault(tuple(heapq.nsmallest(2, map(zlib.crc32, runs))), text)
    return list(first.values())


def _prefixes(text: str) -> set[str]:
    return {w[:k] for w in set(WORD.findall(text.lower())) for k in range(4, min(len(w), 10) + 1)}


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    expected_a, expected_b = (a + b) * n / (n + m), (a + b) * m / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(a > 0, a * np.log(a / expected_a), 0) + np.where(b > 0, b * np.log(b / expected_b), 0))


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, bytes]:
    """The ordinary dictionary holds the words that most ordinary texts have, commonest last, where offsets are short.

    The toxic one adds the word beginnings that toxic texts have far oftener, by their likelihood ratio, each with the
    commonest words that begin so.
    """
    in_toxic: Counter[str] = Counter()
    in_ordinary: Counter[str] = Counter()
    common: Counter[str] = Counter()
    for text in toxic:
        in_toxic.update(_prefixes(text))
    for text in ordinary:
        in_ordinary.update(_prefixes(text))
        common.update(set(WORD.findall(text.lower())))
    seen = sorted(w for w, k in in_toxic.items() if k >= 4)
    a, b = (np.array([c[w] for w in seen], dtype=float) for c in (in_toxic, in_ordinary))
    n, m = len(toxic), len(ordinary)
    lift = (a / n) / ((b + 0.5) / m) if seen else np.zeros(0)
    ratio = np.where(lift >= LEAST_LIFT, _likelihood_ratio(a, b, n, m), 0.0) if seen else np.zeros(0)
    longer = ratio * (1 + 0.03 * np.array([len(w) for w in seen])) if seen else ratio
    fragments: list[str] = []
    beginnings: set[str] = set()
    for i in np.argsort(-longer, kind="stable"):
        if ratio[i] < LEAST_RATIO:
            break
        if not any(seen[i].startswith(f) or f.startswith(seen[i]) for f in fragments):
            fragments.append(seen[i])
            beginnings.add(seen[i])
    whole: Counter[str] = Counter()
    for text in toxic:
        whole.update(w for w in set(WORD.findall(text.lower())) if any(w[:k] in beginnings for k in range(4, 11)))
    ranked = sorted(whole, key=lambda w: (-whole[w], w))
    frequent = sorted(common, key=lambda w: (-common[w], w))[:BASE_WORDS]
    base = " ".join(reversed(frequent)).encode() + b" "

    def with_fragments(chosen: list[str]) -> bytes:
        tail = list(dict.fromkeys(w for f in chosen for w in (f, *[w for w in ranked if w.startswith(f)][:WORDS_OF_FRAGMENT])))
        return base + " ".join(reversed(tail)).encode() + b" "

    number = {f: i for i, f in enumerate(seen)}
    return base, with_fragments(fragments), with_fragments([f for f in fragments if lift[number[f]] >= STRONG_LIFT])


def _calibrate(features: np.ndarray, labels: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression, rows weighted so that the toxic ones make up their share of all labelled rows."""
    centre, scale = features.mean(0), features.std(0) + 1e-9
    own = labels.mean()
    weight = np.where(labels > 0, share / own, (1 - share) / (1 - own)) if 0 < own < 1 else np.ones(len(labels))
    x = np.c_[(features - centre) / scale, np.ones(len(features))]
    w, ridge = np.zeros(x.shape[1]), 0.1
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (p - labels)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, w


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text is divisible by 5; a null id is held out, as no label can name it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, ordinary_rows: int = SAMPLE_ORDINARY) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows that are not held out.

    A document with labels of both kinds counts as toxic; null labels are skipped. Two thirds of the sample make
    the dictionaries that score the other third; so every text of it calibrates the scores. Copies count once.
    """
    truth = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    truth = truth.filter(~held_out(F.col("doc_id"))).withColumn("draw", F.xxhash64("doc_id"))
    drawn = truth.filter("toxic = 1").orderBy("draw", "doc_id").limit(toxic_rows).unionByName(
        truth.filter("toxic = 0").orderBy("draw", "doc_id").limit(ordinary_rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = {r["toxic"]: r["n"] for r in truth.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = drawn.join(texts, "doc_id").select("doc_id", "toxic", "text").toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    toxic, ordinary = rows[rows.toxic == 1], rows[rows.toxic == 0]
    if not len(toxic) or not len(ordinary):
        return ToxicityModel(b"", b"", b"", (), (), (), float(len(toxic) > 0))
    return model_of(toxic.text.tolist(), ordinary.text.tolist(), counts[1] / (counts[0] + counts[1]))


def model_of(toxic: list[str], ordinary: list[str], share: float) -> ToxicityModel:
    """The model of texts of both classes; `share` is that of the toxic among all labelled rows."""
    toxic, ordinary = _unlike(toxic), _unlike(ordinary)
    texts, labels = [*toxic, *ordinary], np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    fold = np.r_[np.arange(len(toxic)), np.arange(len(ordinary))] % FOLDS

    def made(use: np.ndarray) -> tuple[bytes, bytes, bytes]:
        return _dictionaries(*([t for t, y, own in zip(texts, labels, use, strict=True) if own and y == label] for label in (1, 0)))

    features = np.zeros(0)
    for part in range(FOLDS):
        out = fold == part if min(len(toxic), len(ordinary)) >= 2 * FOLDS else np.ones(len(texts), bool)
        scorer = _Scorer(ToxicityModel(*made(~out if not out.all() else out), (), (), (), 0.0))
        rows = np.array([scorer.features(t) for t, own in zip(texts, out, strict=True) if own])
        if not len(features):
            features = np.zeros((len(texts), rows.shape[1]))
        features[out] = rows
    centre, scale, weights = _calibrate(features, labels, share)
    return ToxicityModel(*made(np.ones(len(texts), bool)), tuple(centre), tuple(scale), tuple(weights), share)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = (), into: str = "toxicity") -> DataFrame:
    """Per row of `docs`: doc_id, the columns of `keep`, and `into`, a double from 0 to 1.

    A narrow pass without shuffle. Null and empty texts have one empty window and are scored like any other; other
    columns of `docs` are left out and cannot clash. Repeated rows are scored each.
    """
    columns = list(dict.fromkeys(["doc_id", *keep]))
    frame = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = frame.select(*columns, F.lit(0.0).alias(into)).schema
    return frame.mapInArrow(lambda batches: _scored(batches, model, columns, into), schema)


def _scored(batches: Iterator[pa.RecordBatch], model: ToxicityModel, columns: list[str], into: str) -> Iterator[pa.RecordBatch]:
    scorer = _Scorer(model) if model.weights else None
    for batch in byte_slices(batches, "text"):
        values = [scorer.score(scorer.features(t)) if scorer else model.prior for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(values, pa.float64())], names=[*columns, into])


def reject_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, with their columns."""
    into = free_name(docs, "toxicity")
    return score_toxicity(docs, model, tuple(docs.columns), into).filter(F.col(into) < threshold).select(*docs.columns)


def op9_toxicity_compression(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model fitted on the rows that are not held out.

    Null and empty texts have one empty window and a score of their own; a null doc_id is scored and held out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
