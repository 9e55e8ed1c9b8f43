"""Licence scan by ordered signature rules.

A keyword prefilter picks the rules that can match a text; their matches are then resolved: a match that a match of higher
priority overlaps goes, and so does one that lies within another of the same priority.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import byte_slices, utf8_of
from tessella.llm.license_rules import BASE, FURTHER_TERM, rules

_WORD = np.ones(256, bool)
_WORD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_WORD[65:91] = True  # lower-cased first
_CLASS = rb"0-9a-z\x80-\xff"
_GAP = rb"[^" + _CLASS + rb"]+"
# a name's own marks are dots, dashes and pluses; brackets stand around terms
_TERM = rb"[(\t ]*[0-9a-z.+:-]*[0-9a-z+][)\t ]*"
_TAG = rb"spdx[-_ \t]+(?:(?:file|snippet)[-_ \t]+)?licen[cs]e[-_ \t]+identifier[:\t =\"']+"
_EXPRESSION = re.compile(_TAG + rb"(?=(" + _TERM + rb"(?:(?<=[)\t ])(?:or|and|with)(?=[(\t ])" + _TERM + rb")*))")


def _compiled(pattern: str) -> re.Pattern[bytes]:
    body = pattern.encode().replace(b" ", _GAP)
    return re.compile(rb"(?<![" + _CLASS + rb"])(?:" + body + rb")(?![" + _CLASS + rb"])")


class Scanner:
    """The compiled rules and the automaton of their keywords."""

    def __init__(self) -> None:
        self.rules = [(rule, _compiled(rule.pattern)) for rule in rules()]
        self.base = [(label, phrase.split(" ")[-1].encode(), _compiled(phrase)) for phrase, label in BASE]
        # a keyword of several words is looked for by its longest one, as any separators may stand between them
        needed = [{max(k.split(" "), key=len) for k in rule.keywords if k} for rule, _ in self.rules]
        names = sorted(set().union(*needed))
        number = {name: i for i, name in enumerate(names)}
        often = Counter(k for keys in needed for k in keys)
        #: Rules by the keyword that fewest rules share, with the other keywords that they need.
        self.gated: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for i, keys in enumerate(needed):
            self.gated.setdefault(number[min(keys, key=lambda k: (often[k], k))], []).append((i, frozenset(number[k] for k in keys)))
        self.automaton = ahocorasick.Automaton()
        for name, i in number.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()

    def base_places(self, text: bytes) -> list[tuple[int, int, str]]:
        return sorted((m.start(), m.end(), label) for label, word, p in self.base if word in text for m in p.finditer(text))

    def detections(self, text: bytes) -> list[tuple[int, int, str, int]]:
        """(start, stop, label, priority) that remain, by start; bytes of the lower-cased text."""
        seen = {i for _, i in self.automaton.iter(text.decode("latin-1"))}
        found: dict[int, list[tuple[int, int, int, str]]] = {}
        for gate in seen & self.gated.keys():
            for i, needed in self.gated[gate]:
                if needed <= seen:
                    rule, pattern = self.rules[i]
                    found.setdefault(-rule.priority, []).extend((m.start(), -m.end(), rule.rank, rule.label) for m in pattern.finditer(text))
        if -FURTHER_TERM in found:
            found[-FURTHER_TERM] = within_expression(text, found[-FURTHER_TERM])
        return resolved(found)


def within_expression(text: bytes, terms: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The matches that begin within an SPDX tag's expression: terms joined by or, and, with, in the tag's line."""
    spans = [m.span(1) for m in _EXPRESSION.finditer(text)]
    starts = [a for a, _ in spans]
    kept = []
    for term in terms:
        i = bisect_right(starts, term[0]) - 1
        if i >= 0 and -term[1] <= spans[i][1]:
            kept.append(term)
    return kept


def resolved(found: dict[int, list[tuple[int, int, int, str]]]) -> list[tuple[int, int, str, int]]:
    """What remains of matches (start, -stop, rank, label) by negative priority: a match that overlaps a kept one of higher
    priority goes, and so does one that lies within a kept one of its own priority; of equal spans the first rule stays.
    """
    kept: list[tuple[int, int, str, int]] = []
    for negative in sorted(found):
        taken = _merged([(a, b) for a, b, _, _ in kept])
        starts = [a for a, _ in taken]
        furthest = -1
        for start, minus_stop, _, label in sorted(found[negative]):
            i = bisect_left(starts, -minus_stop) - 1  # the last span of higher priority that starts before its end
            if -minus_stop > furthest and (i < 0 or taken[i][1] <= start):
                kept.append((start, -minus_stop, label, -negative))
                furthest = -minus_stop
    return sorted(kept)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("base", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))),
        ("found", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = scanner()
    for batch in byte_slices(batches, "text"):
        raw, offsets = utf8_of(batch)
        inside = _WORD[raw]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        starts[inner] = inside[inner]
        begins = np.flatnonzero(starts)
        before = np.searchsorted(begins, offsets)
        data, bases, founds = raw.tobytes().lower(), [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text = data[a:b]
            places = scan.base_places(text)
            words = np.searchsorted(begins, [a + p[0] for p in places]) - before[i] if places else ()
            bases.append([{"label": p[2], "first_word": int(w)} for p, w in zip(places, words, strict=True)])
            founds.append([dict(zip(("start", "stop", "label", "priority"), d, strict=True)) for d in scan.detections(text)])
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(before), pa.int64())]
        columns += [pa.array(bases, _SCHEMA.field("base").type), pa.array(founds, _SCHEMA.field("found").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, base and found.

    base has every place of a base phrase: its label and the number of its first word, from 0. found has the resolved
    detections of the rules: start and stop in bytes of the UTF-8 text, label, priority. A narrow pass; null and empty
    texts have no words and nothing found; repeated rows are scanned each; other columns are left out.
    """
    schema = (
        "doc_id long, n_words long, base array<struct<label:string,first_word:long>>, "
        "found array<struct<start:long,stop:long,label:string,priority:int>>"
    )
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)


def op6_license_rules(spark, sf_dir: str) -> DataFrame:
    """score is the highest priority among a document's detections and base places (which count 50), over 100."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = F.transform("base", lambda b: b["first_word"])
    base_labels = F.transform("base", lambda b: b["label"])
    labels = F.concat(base_labels, F.transform("found", lambda d: d["label"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    top = F.coalesce(F.array_max(F.transform("found", lambda d: d["priority"])), F.lit(0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(labels).alias("labels"),
        (F.greatest(top, F.when(F.size("base") > 0, 50).otherwise(0)) / 100.0).cast("double").alias("score"),
    )
