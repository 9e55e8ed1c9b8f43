"""Personal data: exact patterns, and a skip-chain conditional random field over the tokens that could be personal.

Nodes are tokens with a digit or an @, addresses that spell out at and dot, and words that an address of the same document
is named by. Neighbours in the text share a potential. So do tokens with the same key, however far apart, each with the
first of them, and tokens whose keys differ by a letter or two; links grow with the tokens. The key of a token in a run of
numbers is the run's digits, so that a number meets its copies written otherwise. Weights are fitted by pseudo-likelihood
on a bounded sample of texts and on copies of them whose pattern matches are rewritten in ways that the patterns miss.
Tokens in the patterns' spans are evidence; damped sum-product messages carry it through a document until they settle.
Tokens that are near certain to be of a kind and lie outside the patterns' spans become spans, neighbouring ones one span.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import byte_slices, texts_of

# Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Texts of which the field's weights are fitted, those with the smallest hash among texts with a digit or an @.
SAMPLE = 2000
#: Such texts have at most so many bytes, and the fit ends with the text that brings its tokens to so many.
SAMPLE_BYTES, SAMPLE_TOKENS = 1 << 16, 200_000
#: The least marginal probability with which a token becomes a span.
CERTAIN = 0.9
#: Added to the label that a pattern's span gives a token.
EVIDENCE = 12.0
#: Messages pass until none changes by more than SETTLED, and at most so many rounds.
ROUNDS, SETTLED, DAMPING = 100, 1e-3, 0.4
#: Bytes of texts whose tokens are held at once, and messages that are computed at once.
SLICE_BYTES, EDGE_BLOCK = 1 << 19, 1 << 16
NEAR = 24  # characters between tokens that are neighbours
_MARK = re.compile("[0-9@]")
_BREAK = re.compile(r"[\s,;:()<>\[\]{}\"'|]")
_LABELS = len(KINDS) + 1
_AT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?| at ", re.IGNORECASE)
_DOT = re.compile(r"(\s?[\[({<]\s?dot\s?[\])}>]\s?| dot )|\.", re.IGNORECASE)
_HOST = re.compile("[A-Za-z0-9-]++")
_NUMBER = re.compile(r"\+?[0-9][0-9./*_-]*")
_GAP = re.compile(r"[^0-9A-Za-z]{1,3}")
#: Keys of so many letters are linked with keys that differ by a letter or two.
SIMILAR = range(8, 41)
#: Words before a token that tell what follows, by kind.
CUES = (("mail", "write"), ("host", "server", "address"), ("card", "visa", "credit"), ("phone", "call", "tel", "fax", "mobile"))
WIDTH = 28  # features of a token


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            free = match.end()
        else:
            free = at  # the part before an @ never reaches over it
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass their checks, in code points, by start and kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def spelled_addresses(text: str) -> list[tuple[int, int, bool]]:
    """(start, stop, bracketed) of addresses that spell out at and dot; a bare at needs a spelled dot after it."""
    out, free = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, m.end()) if start < m.start() else None
        if not host:
            continue
        bracketed, spelled, stop = m[0] != m[0].strip("[({<])}> ") and m[0].strip()[0] in "[({<", False, host.end()
        while (dot := _DOT.match(text, stop)) and (host := _HOST.match(text, dot.end())):
            spelled, stop = spelled or dot[1] is not None, host.end()
        if bracketed or spelled:
            out.append((start, stop, bracketed))
            free = stop
    return out


@dataclass
class Tokens:
    """The nodes of some texts: text number, span, key that equal tokens share, and features."""

    text: array
    start: array
    stop: array
    key: list[str]
    features: array

    def __init__(self) -> None:
        self.text, self.start, self.stop, self.key, self.features = array("q"), array("q"), array("q"), [], array("f")

    def add(self, number: int, text: str, emails: list[tuple[int, int]]) -> None:
        """A text's tokens in order: runs between breaks that hold a digit or an @, spelled addresses, and words that
        addresses are named by.
        """
        spelled = {(a, b): bracketed for a, b, bracketed in spelled_addresses(text)}
        spans, free = list(spelled), 0
        inside = _Disjoint([(a, 0, b) for a, b in spelled])
        for m in _MARK.finditer(text):
            if m.start() < free:
                continue
            start = m.start()
            while start > free and not _BREAK.match(text, start - 1):
                start -= 1
            end = _BREAK.search(text, m.end())
            free = end.start() if end else len(text)
            stop = free
            while stop > start + 1 and text[stop - 1] in ".!?-":
                stop -= 1
            if not inside.first(start, stop):
                spans.append((start, stop))
        names = {text[a:b].partition("@")[0] for a, b in emails}
        names = {n for n in names if len(n) >= 5 and not _MARK.search(n)}
        if names:
            taken = _Disjoint(sorted([(a, 0, b) for a, b in [*spans, *emails]]))
            for m in re.finditer(r"[A-Za-z._%+-]{5,}", text):
                if m[0] in names and not taken.first(m.start(), m.end()):
                    spans.append((m.start(), m.end()))
        spans.sort()
        for run in _runs(text, spans):
            first, last = run[0][0], run[-1][1]
            whole = text[first:last]
            parts = re.findall("[0-9]+", whole)
            digits, written = "".join(parts), len(run) > 1 or _NUMBER.fullmatch(whole) is not None
            n = len(digits)
            quad = len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
            before = re.findall("[a-z]+", text[max(0, first - NEAR) : first].lower())[-2:]
            shared = [written and 9 <= n <= 15, written and 12 <= n <= 19, written and 12 <= n <= 19 and _luhn(digits), written and quad,
                      written and whole[0] == "+", written and whole[0] == "0", len(run) > 1, len(parts) == 4, len(parts) > 4, len(set(whole) & set("./_*")) > 0,
                      *(any(w.startswith(cue) for w in before for cue in cues) for cues in CUES)]
            for start, stop in run:
                token = text[start:stop]
                own = re.sub("[^0-9]", "", token)
                name, at, host = token.partition("@")
                letters = any(c.isalpha() for c in name)
                bracketed = spelled.get((start, stop))
                if bracketed is not None:
                    name, at = _AT.split(token, maxsplit=1)[0], "@"
                self.text.append(number)
                self.start.append(start)
                self.stop.append(stop)
                self.key.append(digits if written and n >= 5 else (name if at and len(name) >= 5 else token).lower())
                self.features.extend([
                    1.0, bool(at) and bracketed is None, bool(at) and "." in host, bracketed is True, bracketed is False, token in names,
                    len(own) >= 4, len(own) >= 7, len(own) >= 12, len(own) / max(1, len(token)), "-" in token, letters, written, min(len(token), 40) / 40, *shared,
                ])

    def graph(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges (a, b, kind) as a matrix and features as one; kind 0 joins neighbours, 1 equal keys, 2 similar keys."""
        n = len(self.text)
        text, start, stop = (np.frombuffer(x, np.int64) if n else np.zeros(0, np.int64) for x in (self.text, self.start, self.stop))
        following = np.flatnonzero((text[1:] == text[:-1]) & (start[1:] - stop[:-1] <= NEAR))
        first: dict[tuple[int, str], int] = {}
        hub = np.array([first.setdefault(k, i) for i, k in enumerate(zip(self.text, self.key, strict=True))], np.int64)
        again = np.flatnonzero(hub != np.arange(n))
        new = [i for i in first.values() if len(self.key[i]) in SIMILAR]
        del first
        similar = self._similar(new)
        parts = [(following, following + 1, 0), (hub[again], again, 1), (similar[:, 0], similar[:, 1], 2)]
        edges = np.concatenate([np.stack([a, b, np.full(len(a), kind)], axis=1) for a, b, kind in parts])
        return edges[np.argsort(edges[:, 1], kind="stable")], np.frombuffer(self.features, np.float32).reshape(n, WIDTH) if n else np.zeros((0, WIDTH), np.float32)

    def _similar(self, tokens: list[int]) -> np.ndarray:
        """(a, b) of tokens of one text whose keys agree up to a left out character, a being the first that has the variant.

        Variants are told apart by 64-bit hashes, so that a token takes some bytes for each and no strings.
        """
        signs, owners = array("q"), array("q")
        for i in tokens:
            key, text = self.key[i], self.text[i]
            own = {hash((text, v)) for v in (key, *(key[:k] + key[k + 1 :] for k in range(len(key))))}
            signs.extend(own)
            owners.extend([i] * len(own))
        if not signs:
            return np.zeros((0, 2), np.int64)
        sign, owner = np.frombuffer(signs, np.int64), np.frombuffer(owners, np.int64)
        order = np.lexsort((owner, sign))
        sign, owner = sign[order], owner[order]
        heads = np.concatenate([[True], sign[1:] != sign[:-1]])
        holder = owner[heads][np.cumsum(heads) - 1]
        later = holder != owner
        return np.unique(np.stack([holder[later], owner[later]], axis=1), axis=0)

    def truth(self, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
        """Each token's label by the patterns: 0 for none, else 1 + kind of the first span that overlaps it."""
        out = np.zeros(len(self.text), np.int64)
        places = [_Disjoint(s) for s in spans]
        for i, (text, a, b) in enumerate(zip(self.text, self.start, self.stop, strict=True)):
            out[i] = places[text].first(a, b)
        return out


def _runs(text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The tokens in groups: numbers with only marks between them together, each other token alone."""
    out: list[list[tuple[int, int]]] = []
    number = False
    for start, stop in spans:
        fits = _NUMBER.fullmatch(text, start, stop) is not None
        if number and fits and text[start] != "+" and _GAP.fullmatch(text, out[-1][-1][1], start):
            out[-1].append((start, stop))
        else:
            out.append([(start, stop)])
        number = fits
    return out


class _Disjoint:
    """Sorted spans of a text, looked up by tokens that come in order."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.spans, self.at, self.active = spans, 0, []

    def first(self, start: int, stop: int) -> int:
        while self.at < len(self.spans) and self.spans[self.at][0] < stop:
            self.active.append(self.spans[self.at])
            self.at += 1
        self.active = [s for s in self.active if s[2] > start]
        return next((1 + kind for a, kind, b in self.active if a < stop), 0)


@dataclass(frozen=True)
class Field:
    """Weights of tokens' features by label, and potentials of neighbours and of equal tokens."""

    weights: np.ndarray
    potentials: np.ndarray

    def marginals(self, edges: np.ndarray, features: np.ndarray, evidence: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        """Each node's label probabilities by damped sum-product messages along both directions of every edge.

        evidence has each node's label by the patterns, 0 for none; owner each node's document. A document's messages stop
        when they have settled, whatever other documents do.
        """
        unary = features @ self.weights
        unary[np.flatnonzero(evidence), evidence[evidence > 0]] += EVIDENCE
        n, m = len(unary), len(edges)
        if not m:
            return _softmax(unary)
        owner = np.zeros(n, np.int64) if owner is None else owner
        source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        kind, turned = np.r_[edges[:, 2], edges[:, 2]], np.arange(2 * m) >= m
        back, of = np.r_[np.arange(m, 2 * m), np.arange(m)], owner[source]
        messages = np.zeros((2 * m, _LABELS))
        alive = np.ones(int(owner.max()) + 1, bool)
        for _ in range(ROUNDS):
            belief = unary + _sums(messages, target, n)
            after = messages.copy()
            moved = np.zeros(len(alive))
            live = np.flatnonzero(alive[of])
            for at in range(0, len(live), EDGE_BLOCK):
                e = live[at : at + EDGE_BLOCK]
                pair = np.where(turned[e][:, None, None], self.potentials[kind[e]].transpose(0, 2, 1), self.potentials[kind[e]])
                cavity = (belief[source[e]] - messages[back[e]])[:, :, None] + pair
                top = cavity.max(axis=1)
                new = top + np.log(np.exp(cavity - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                after[e] = DAMPING * messages[e] + (1 - DAMPING) * new
                np.maximum.at(moved, of[e], np.abs(after[e] - messages[e]).max(axis=1))
            messages = after
            alive &= moved >= SETTLED
            if not alive.any():
                break
        return _softmax(unary + _sums(messages, target, n))


def _sums(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# How a copy's matches are rewritten so that the patterns miss them, by kind: pairs of old and new.
_REWRITES: tuple[tuple[tuple[tuple[str, str], ...], ...], ...] = (
    ((("@", " at "), (".", " dot ")), (("@", "(at)"), (".", "(dot)")), (("@", " [at] "),), (("@", "(at)"), (".", " dot "))),
    (((".", " "),), ((".", "[.]"),), ((".", ","),), ((".", "-"),), ((".", " . "),)),
    (((" ", ""), ("-", "")),),
    (((" ", "."), ("-", ".")), ((" ", "/"), ("-", "/"), ("(", ""), (")", "")), ((" ", " "),)),
)


def _rewritten(match: str, kind: int, random: np.random.Generator) -> str:
    choice = _REWRITES[kind][random.integers(len(_REWRITES[kind]))]
    name, at, host = match.partition("@")
    if kind == 0 and random.random() < 0.25:
        return f"{name}@{host.replace('.', '')}"
    if kind == 0:  # dots in the name stay
        for old, new in choice:
            at, host = at.replace(old, new), host.replace(old, new)
        return name + at + host
    for old, new in choice:
        match = match.replace(old, new)
    if kind == 2:
        size, mark = int(random.integers(3, 6)), (".", "/", "  ", "_")[random.integers(4)]
        return mark.join(match[i : i + size] for i in range(0, len(match), size))
    return match if kind != 3 else ("00", "0", "")[random.integers(3)] + match.lstrip("+")


def corrupted(text: str, spans: list[tuple[int, int, int]], seed: int, share: float = 0.6) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with about a share of its matches rewritten, and the spans of the rewritten ones that no pattern finds."""
    random = np.random.default_rng(seed)
    out, places, at, size = [], [], 0, 0
    for start, kind, stop in spans:
        if start < at or random.random() >= share:
            continue
        own = _rewritten(text[start:stop], kind, random)
        out += [text[at:start], own]
        size += start - at + len(own)
        places.append((size - len(own), kind, size))
        at = stop
    text = "".join(out) + text[at:]
    found = _Disjoint(base_spans(text))
    return text, [p for p in places if not found.first(p[0], p[2])]


def fit_field(texts: list[str], steps: int = 800, rate: float = 0.5, decay: float = 1e-5, copies: int = 2) -> Field:
    """Weights by pseudo-likelihood: each token given its features and its linked tokens' labels.

    The truth is the patterns' spans and, in `copies` rewritten copies of each text with such spans, the rewritten ones
    too. Tokens with a known token's key outside all of these are left out. Potentials are kept symmetric. Without tokens
    all weights favour no label, so that nothing is added.
    """
    tokens, spans = Tokens(), []

    def learn(text: str, more: list[tuple[int, int, int]], emails: list[tuple[int, int]]) -> None:
        tokens.add(len(spans), text, emails)
        spans.append(sorted(base_spans(text) + more))

    for i, text in enumerate(texts):
        if len(tokens.text) >= SAMPLE_TOKENS:
            break
        found = base_spans(text)
        learn(text, [], [(a, b) for a, kind, b in found if kind == 0])
        for copy in range(copies if found else 0):
            other, more = corrupted(text, found, i * copies + copy)
            learn(other, more, [(a, b) for a, kind, b in base_spans(other) if kind == 0])
    edges, x = tokens.graph()
    if not len(x):
        weights = np.zeros((WIDTH, _LABELS))
        weights[0, 0] = 10.0
        return Field(weights, np.zeros((3, _LABELS, _LABELS)))
    truth = tokens.truth(spans)
    y = np.eye(_LABELS)[truth]
    known = {(t, k) for t, k, label in zip(tokens.text, tokens.key, truth, strict=True) if label}
    unknown = np.array([(t, k) in known for t, k in zip(tokens.text, tokens.key, strict=True)]) & (truth == 0)
    y[unknown] = 0
    weights, potentials = np.zeros((x.shape[1], _LABELS)), np.zeros((3, _LABELS, _LABELS))
    speed_w, speed_p = np.zeros_like(weights), np.zeros_like(potentials)
    source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    kind = np.r_[edges[:, 2], edges[:, 2]]
    # shares of linked labels, so that a token with many links is no stronger than one with few
    around = [_sums(y[source[kind == k]], target[kind == k], len(x)) for k in range(3)]
    around = [a / np.maximum(1, a.sum(axis=1, keepdims=True)) for a in around]
    for _ in range(steps):
        p = _softmax(x @ weights + sum(around[k] @ potentials[k] for k in range(3)))
        error = np.where(unknown[:, None], 0, p - y) / len(x)
        speed_w = 0.9 * speed_w + x.T @ error + decay * weights
        gradient = np.stack([around[k].T @ error for k in range(3)])
        speed_p = 0.9 * speed_p + (gradient + gradient.transpose(0, 2, 1)) / 2 + decay * potentials
        weights, potentials = weights - rate * speed_w, potentials - rate * speed_p
    return Field(weights, potentials)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most `sample` texts with a digit or an @, drawn by the hash of the row, and rewritten copies of them.

    Rows are counted first and thinned by their hash where they stand, so that tasks send about `sample` texts in all.
    """
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("draw")).filter(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= SAMPLE_BYTES))
    share = min(1.0, 1.5 * sample / max(1, texts.count()))
    drawn = texts.filter(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30)))
    return fit_field([r["text"] for r in drawn.orderBy("draw", "text").limit(sample).select("text").collect()])


def spans_of(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Each text's base spans and all its spans."""
    base = [base_spans(t) for t in texts]
    tokens = Tokens()
    for i, (text, spans) in enumerate(zip(texts, base, strict=True)):
        tokens.add(i, text, [(a, b) for a, kind, b in spans if kind == 0])
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if tokens.text:
        taken = tokens.truth(base)
        p = field.marginals(*tokens.graph(), taken, np.frombuffer(tokens.text, np.int64))
        label = p.argmax(axis=1)
        before = -2
        for i in np.flatnonzero((label > 0) & (taken == 0) & (p.max(axis=1) >= CERTAIN)).tolist():
            number, start, kind, stop = tokens.text[i], tokens.start[i], int(label[i]) - 1, tokens.stop[i]
            last = added[number][-1] if added[number] else None
            if before == i - 1 and last and last[1] == kind > 0 and _GAP.fullmatch(texts[number], last[2], start):
                added[number][-1] = (last[0], kind, stop)
            else:
                added[number].append((start, kind, stop))
            before = i
    return [(b, sorted(b + a)) for b, a in zip(base, added, strict=True)]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", SLICE_BYTES):
        found = spans_of(texts_of(batch), field)
        columns = [batch.column("doc_id").cast(pa.int64())]
        for k in (0, 1):
            rows = [[{"kind": KINDS[kind], "start": a, "stop": b} for a, kind, b in spans[k]] for spans in found]
            columns.append(pa.array(rows, pa.list_(_SPAN)))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "spans"])


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of `docs`: doc_id, base and spans, arrays of (kind, start, stop) in code points, by start and kind.

    A narrow pass. Null and empty texts have no spans; repeated rows are searched each; other columns are left out.
    """
    array = "array<struct<kind:string,start:long,stop:long>>"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _find(batches, field), f"doc_id long, base {array}, spans {array}")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for start, kind, stop in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """`docs` with personal data in `text` replaced; null texts stay null, other columns pass as they are."""
    return docs.mapInArrow(lambda batches: _clean(batches, field), docs.schema)


def _clean(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", SLICE_BYTES):
        texts = texts_of(batch)
        done = [redacted(t, spans) for t, (_, spans) in zip(texts, spans_of(texts, field), strict=True)]
        nulls = batch.column("text").is_null().to_pylist()
        fresh = pa.array([None if null else t for null, t in zip(nulls, done, strict=True)], batch.schema.field("text").type)
        yield pa.RecordBatch.from_arrays([fresh if f.name == "text" else c for f, c in zip(batch.schema, batch.columns, strict=True)], schema=batch.schema)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op4_skip_chain(spark, sf_dir: str) -> DataFrame:
    """n_email, n_ip, n_card and n_phone count the base spans, n_added those of the field alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal_data(docs, fit(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
