"""Alignment of two tokenizers' tokens over the bytes of each text.

Both tokenizers work within words of their own. A text is cut into units, at whose ends both have a word's end; each distinct
unit is asked for once, aligned once and remembered with its links and groups, so that a document is the sum of its units.
Units that are a word of both are asked for by the line: the ids' decoded bytes must give the line back, and say which tokens
are whose. Of the others token spans come from the libraries: character offsets of the byte-level tokenizer, begin and end of
each piece in the piece model's proto. They are coarse cuts: a character that several byte-level tokens share, and a piece
that stands for one byte, are refined by the tokens' decoded bytes. Byte offsets where both have a token's end cut a text into
groups.

Counts over the corpus meet the documents by blocks. A task sums up the pairs of a block of documents; a block's distinct
pairs, numbered, are counted over all blocks and return to it with the totals. Documents hold numbers of pairs alone, so
what is shuffled follows the distinct pairs of each block and not the links.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate, chain
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.batches import byte_slices, texts_of
from tessella.llm.pieces import SPACE
from tessella.llm.token_records import _OTHER, _WORDS, _byte_letters
from tessella.storage import materialize

if TYPE_CHECKING:
    from tokenizers import Encoding

#: Bytes of text of a block, characters of a run that is aligned at once, distinct units that a worker remembers, and their links.
BLOCK_BYTES, RUN_CHARS, MEMO_UNITS, MEMO_LINKS = 4 << 20, 1 << 18, 250_000, 4 << 20
#: Units in a line that is tokenized at once.
LINE_UNITS = 100
#: Pair numbers in one batch that leaves a task.
BATCH_PAIRS = 1 << 20
#: Texts in one batch that reaches a task.
BATCH_ROWS = 500
#: Longer texts are cut here, where either tokenizer has a word's end.
_CUT = re.compile("[A-Za-z](?= [A-Za-z])")
#: Letters, and marks between which and letters words may end.
_LETTERS, _MARKS = "A-Za-z\xc0-\u024f", "\n.,!?;:"
#: Those of the letters that the byte-level tokenizer takes for letters too.
_BOTH = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PLAIN = re.compile(f" ?[{_BOTH}]+").fullmatch
#: What a word's bytes are where its pieces do not give them back.
_LOST = np.array([[0, 1 << 31]], np.uint32).tobytes()


class ByteTokens(dict):
    """Words to their byte-level ids and byte counts, by the library's character offsets."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        letters = _byte_letters()
        known = {c: b for b, c in letters.items()}
        self.letters = {b: c for b, c in letters.items() if b < 128}
        self.bytes_of = {i: bytes(known[c] for c in token) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in known for c in token)}
        self.pairs = {i: _interleaved([i], [len(decoded)]) for i, decoded in self.bytes_of.items()}

    def spans(self, text: str, found: Encoding | None = None) -> bytes:
        found = found or self.tokenizer.encode(text, add_special_tokens=False)
        ids, offsets = found.ids, found.offsets
        at = [0, *accumulate([1 if c < "\x80" else len(c.encode()) for c in text])]
        starts = [start for start, _ in offsets] + [len(text)]
        sizes, before = [], 0
        for i, (start, stop) in enumerate(offsets):
            # a token whose characters are its own has their bytes; one that shares a character has its decoded bytes
            own = before <= start and stop <= starts[i + 1]
            sizes.append(at[stop] - at[start] if own else len(self.bytes_of[ids[i]]))
            before = stop
        return _interleaved(ids, sizes)

    def learn(self, words: set[str]) -> None:
        """Remember words of the split pattern. In ASCII a token has as many bytes as characters, and needs no offsets."""
        merge, letters, pairs = self.tokenizer.model.tokenize, self.letters, self.pairs
        others = []
        for word in words:
            if word.isascii():
                self[word] = b"".join([pairs[t.id] for t in merge(word.translate(letters))])
            else:
                others.append(word)
        for word, found in zip(others, self.tokenizer.encode_batch(others, add_special_tokens=False), strict=True):
            self[word] = self.spans(word, found)


class PieceTokens(dict):
    """Blank-led words to their piece ids and byte counts, by the spans of the library's proto."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.byte = {i: int(model.id_to_piece(i)[3:5], 16) for i in range(self.size) if model.is_byte(i)}
        names = list(map(model.id_to_piece, range(self.size)))
        self.bytes_of = [bytes([self.byte[i]]) if i in self.byte else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.pairs = [_interleaved([i], [len(decoded)]) for i, decoded in enumerate(self.bytes_of)]
        self.blank = _interleaved([model.piece_to_id(SPACE)], [1])
        # words end before blanks, as no piece holds one after another character, and between letters and such marks as no
        # piece holds next to a letter
        listed = "\0".join(names)
        marks = "".join(m for m in _MARKS if not re.search(f"[{_LETTERS}]{re.escape(m)}|{re.escape(m)}[{_LETTERS}]", listed))
        between = f"(?<=[{_LETTERS}])(?=[{marks}])|(?<=[{marks}])(?=[{_LETTERS}])|" if marks else ""
        quick = f" *[{_LETTERS}]+(?=[{marks} ]|\\Z)|[{marks}]+(?=[{_LETTERS} ]|\\Z)|" if marks else ""
        self.words = re.compile(f"{quick} *[^ ]+?(?:{between}(?= )|\\Z)| +").findall
        #: What stands before a word without a blank, by whether it begins with a mark; its pieces are left out.
        self.before = {begins: (p, len(model.encode(p))) for begins, p in ((True, "a"), (False, ","))}
        self.marks = frozenset(marks)

    def learn(self, words: set[str]) -> None:
        """Remember words; the library adds their first blank. In ASCII a piece has as many bytes as characters."""
        plain, others = [], []
        for word in words:
            prefix, n = ("", 0) if word[0] == " " else self.before[word[0] in self.marks]
            (plain if word.isascii() else others).append((word, prefix + word if prefix else word[1:], n))
        found = [ids[n:] for (_, _, n), ids in zip(plain, self.model.encode([t for _, t, _ in plain], num_threads=1), strict=True)]
        names, pairs, decoded = [word for word, _, _ in plain], self.pairs.__getitem__, self.bytes_of.__getitem__
        if b"".join(map(decoded, chain.from_iterable(found))) == "".join(names).encode():
            self.update(zip(names, [b"".join(map(pairs, ids)) for ids in found], strict=True))
        else:
            for word, ids in zip(names, found, strict=True):
                self[word] = b"".join(map(pairs, ids)) if b"".join(map(decoded, ids)) == word.encode() else _LOST
        for (word, text, n), proto in zip(others, self.model.encode([t for _, t, _ in others], out_type="proto", num_threads=1), strict=True):
            ids, sizes, raw = [], [], word.encode()
            before = len(text.encode()) - len(raw)  # -1 where the library adds the blank
            for piece in list(proto.pieces)[n:]:
                i, stop = piece.id, piece.end
                ids.append(i)
                # a piece of one byte has the span of its character, or none
                sizes.append(1 if i in self.byte else stop - before)
                before = stop
            decoded = [self.bytes_of[i] for i in ids]
            if b"".join(decoded) != raw:
                self[word] = _LOST
            else:
                self[word] = _interleaved(ids, sizes if sum(sizes) == len(raw) else list(map(len, decoded)))
        if " " in words:
            self[" "] = self.blank  # no text after the blank, so that the library adds none


def _interleaved(ids: list[int], sizes: list[int]) -> bytes:
    out = array("I", bytes(8 * len(ids)))
    out[::2], out[1::2] = array("I", ids), array("I", sizes)
    return out.tobytes()


def _pairs(raw: bytes) -> np.ndarray:
    """(id, bytes) of each token."""
    return np.frombuffer(raw, np.uint32).reshape(-1, 2).astype(np.int64)


def segments(text: str, least: int = RUN_CHARS) -> Iterator[str]:
    """A text, a blank before it, cut after about `least` characters where a word of both tokenizers ends."""
    text, start = f" {text}", 0
    while len(text) - start > least and (cut := _CUT.search(text, start + least)):
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


class _Document:
    """What is known of one document while its segments pass."""

    def __init__(self, with_groups: bool) -> None:
        self.digest, self.numbers, self.lost, self.bytes = hashlib.sha256(), np.zeros(4, np.int64), False, 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.text: list[str] | None = [] if with_groups else None
        self.cuts: list[np.ndarray] = []

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) < 2:
            return (self.keys[0], self.times[0]) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.times = [keys], [np.bincount(at, np.concatenate(self.times)).astype(np.int64)]
        return keys, self.times[0]


def unit_pattern(marks: frozenset[str]) -> str:
    """Stretches of text, each up to a place where words of both tokenizers end whatever follows: before a blank after what is
    no white space; between a letter and one of `marks`; and between a line feed that stands alone and a letter.
    """
    points = "".join(sorted(marks - {"\n"}))
    before, after = "".join(sorted(marks)), f"(?<=[{_BOTH}])(?=[{{}}])"
    ends = [r"(?<=\S)(?= )", r"\Z"]
    if before:
        ends.append(after.format(before))
    if points:
        ends.append(f"(?<=[{points}])(?=[{_BOTH}])")
    if "\n" in marks:
        ends.append(rf"(?<=\S\n)(?=[{_BOTH}])")
    quick = [f" ?[{_BOTH}]+(?=[{before} ]|\\Z)"]
    if points:
        quick.append(f"[{points}]+(?=[{_BOTH} ]|\\Z)")
    return "|".join([*quick, f"(?s:.)+?(?:{'|'.join(ends)})"])


class _Table:
    """Numbers by row, with room to grow."""

    def __init__(self, kind: type, *width: int) -> None:
        self.held, self.n = np.zeros((1 << 12, *width), kind), 0

    def append(self, rows: np.ndarray) -> None:
        n = self.n + len(rows)
        if n > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros((n * 5 // 4 - self.n, *self.held.shape[1:]), self.held.dtype)])
        self.held[self.n : n] = rows
        self.n = n


class Units(dict):
    """Units of text to their numbers, under which `facts`, `texts` and, by start, `links` and, if asked for, `ends` tell
    their alignment.
    """

    #: Columns of `facts`: tokens, groups, links, bytes, whether a tokenizer does not give the unit back, first link and end.
    A, B, GROUPS, LINKS, BYTES, LOST, LINK, END = range(8)

    def __init__(self, byte_path: str, piece_path: str, with_ends: bool = False) -> None:
        super().__init__()
        self.a, self.b, self.with_ends = ByteTokens(byte_path), PieceTokens(piece_path), with_ends
        sizes = np.zeros(max(self.a.size, *(i + 1 for i in self.a.bytes_of)), np.int64)
        sizes[list(self.a.bytes_of)] = list(map(len, self.a.bytes_of.values()))
        self.sizes_a, self.sizes_b = sizes, np.array(list(map(len, self.b.bytes_of)))
        #: Of a group's text the ids, and behind them the marks after one: another follows, `b` follows, the group ends, the unit ends.
        self.names = [*map(str, range(max(len(sizes), self.b.size))), ",", "|", ";", ";\n"]
        self.cut = re.compile(unit_pattern(self.b.marks)).findall
        self.new: list[str] = []
        self.forget()

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n

    def forget(self) -> None:
        self.clear()
        self.facts, self.links, self.ends, self.texts = _Table(np.int32, 8), _Table(np.int64), _Table(np.int64), []

    def numbers(self, parts: list[str]) -> list[np.ndarray]:
        """The numbers of each part's units in order, all of them learned."""
        if len(self) > MEMO_UNITS or self.links.n > MEMO_LINKS:
            self.forget()
        found = [np.fromiter(map(self.__getitem__, units), np.int64, len(units)) for units in map(self.cut, parts)]
        if self.new:
            self._learn(self.new)
            self.new = []
        return found

    def _learn(self, units: list[str]) -> None:
        led, bare, others = [], [], []
        for i, unit in enumerate(units):
            (others if not _PLAIN(unit) else led if unit[0] == " " else bare).append(i)
        lines = [led[k : k + LINE_UNITS] for k in range(0, len(led), LINE_UNITS)]
        words = [list(map(units.__getitem__, line)) for line in lines]
        if "," in self.b.marks:
            # letters without a blank stand after a comma, which is left out
            more = [bare[k : k + LINE_UNITS] for k in range(0, len(bare), LINE_UNITS)]
            lines += [[-1, *chain.from_iterable((-1, i) for i in line)] for line in more]
            words += [[" a", *chain.from_iterable((",", units[i]) for i in line)] for line in more]
        else:
            others += bare
        order, tokens_a, tokens_b, counts = [], [], [], []
        texts = list(map("".join, words))
        all_a = [self.a.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]  # on this task's thread alone
        all_b = self.b.model.encode([text[1:] for text in texts], num_threads=1)
        of_a, of_b = self.a.bytes_of.get, self.b.bytes_of.__getitem__
        for line, own, text, ids_a, ids_b in zip(lines, words, texts, all_a, all_b, strict=True):
            raw = text.encode()
            same = b"".join([of_a(i, b"") for i in ids_a]) == raw and b"".join(map(of_b, ids_b)) == raw
            ids_a, ids_b, stops = np.array(ids_a), np.array(ids_b), np.cumsum([len(w.encode()) for w in own])
            a, b = np.stack([ids_a, self.sizes_a[ids_a]], 1) if same else None, np.stack([ids_b, self.sizes_b[ids_b]], 1) if same else None
            if same:
                ends_a, ends_b = np.cumsum(a[:, 1]), np.cumsum(b[:, 1])
                at_a, at_b = np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops)
                same = bool((ends_a[at_a] == stops).all() and (ends_b[at_b] == stops).all())
            if not same:
                others += [i for i in line if i >= 0]
                continue
            n_a, n_b, kept = np.diff(at_a + 1, prepend=0), np.diff(at_b + 1, prepend=0), np.array(line) >= 0
            order.append(np.array(line)[kept])
            tokens_a.append(a[np.repeat(kept, n_a)])
            tokens_b.append(b[np.repeat(kept, n_b)])
            counts.append(np.stack([n_a, n_b, np.diff(stops, prepend=0), np.zeros(len(line), np.int64)], 1)[kept])
        self._learn_by_words([units[i] for i in others], tokens_a, tokens_b, counts)
        order.append(np.array(others, np.int64))
        self._align(np.concatenate(order), np.concatenate(tokens_a), np.concatenate(tokens_b), np.concatenate(counts))

    def _learn_by_words(self, units: list[str], tokens_a: list[np.ndarray], tokens_b: list[np.ndarray], counts: list[np.ndarray]) -> None:
        words_a = [None if _OTHER.search(unit) else _WORDS.findall(unit) for unit in units]
        words_b = list(map(self.b.words, units))
        for memo, words in ((self.a, words_a), (self.b, words_b)):
            memo.learn(set(chain.from_iterable(filter(None, words))))
        found = []
        for unit, own_a, own_b in zip(units, words_a, words_b, strict=True):
            size = len(unit.encode())
            a = _pairs(self.a.spans(unit) if own_a is None else b"".join(map(self.a.__getitem__, own_a)))
            b = _pairs(b"".join(map(self.b.__getitem__, own_b)))
            lost = int(b[:, 1].sum()) != size or int(a[:, 1].sum()) != size
            tokens_a.append(a[: 0 if lost else None])
            tokens_b.append(b[: 0 if lost else None])
            found.append((len(tokens_a[-1]), len(tokens_b[-1]), 0 if lost else size, lost))
        for memo in (self.a, self.b):
            memo.clear()
        tokens_a.append(np.zeros((0, 2), np.int64))
        tokens_b.append(np.zeros((0, 2), np.int64))
        counts.append(np.array(found, np.int64).reshape(-1, 4))

    def _align(self, order: np.ndarray, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> None:
        """Take in units by their places in `order` among the new ones: all their tokens, and a row of counts of each."""
        ends_a, ends_b = np.cumsum(a[:, 1]), np.cumsum(b[:, 1])
        starts_a, starts_b = ends_a - a[:, 1], ends_b - b[:, 1]
        shared_a, shared_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        done_a, done_b = np.cumsum(shared_a), np.cumsum(shared_b)
        # all pairs of tokens whose bytes overlap
        first = np.searchsorted(ends_b, starts_a, "right")
        n = np.searchsorted(starts_b, ends_a, "left") - first
        before = np.cumsum(n) - n
        of_a = np.repeat(np.arange(len(a)), n)
        of_b = np.arange(len(of_a)) + np.repeat(first - before, n)
        # a group's tokens side by side, those of `a` first
        to_a, to_b = np.cumsum(counts[:, :2], axis=0).T
        closing = np.zeros(len(b), np.int64)
        closing[to_b[counts[:, 1] > 0] - 1] = 1
        codes = np.empty((len(a) + len(b), 2), np.int64)
        last_a, last_b = np.flatnonzero(shared_a) + 1, np.flatnonzero(shared_b) + 1
        follows = len(self.names) - 4
        codes[np.arange(len(a)) + np.append(0, last_b)[done_a - shared_a]] = np.stack([a[:, 0], follows + shared_a], 1)
        codes[np.arange(len(b)) + last_a[done_b - shared_b]] = np.stack([b[:, 0], follows + 2 * shared_b + closing], 1)
        texts = iter("".join(map(self.names.__getitem__, codes.ravel().tolist())).split("\n"))
        upto, links = np.append(0, done_a), np.append(0, np.cumsum(n))
        facts, from_a = np.empty((len(order), 8), np.int64), to_a - counts[:, 0]
        facts[:, [self.A, self.B, self.BYTES, self.LOST]] = counts
        facts[:, self.GROUPS] = upto[to_a] - upto[from_a]
        facts[:, self.LINKS] = links[to_a] - links[from_a]
        facts[:, self.LINK] = links[from_a] + self.links.n
        facts[:, self.END] = upto[from_a] + self.ends.n
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        own = [next(texts) if n else "" for n in counts[:, 0].tolist()]
        self.texts += map(own.__getitem__, at.tolist())
        self.facts.append(facts[at])
        self.links.append(a[of_a, 0] * self.b.size + b[of_b, 0])
        if self.with_ends:
            starts = np.cumsum(counts[:, 2]) - counts[:, 2]
            self.ends.append((ends_a - np.repeat(starts, counts[:, 0]))[shared_a])


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places from each first one, n of them, one list after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class Aligner:
    """Aligns the segments of documents, a run of them at once."""

    def __init__(self, byte_path: str, piece_path: str, with_groups: bool = False) -> None:
        self.units, self.with_groups = Units(byte_path, piece_path, with_groups), with_groups

    def documents(self, texts: list[str]) -> list[_Document]:
        """Each text's alignment; texts that the pieces do not give back, and empty ones, have none."""
        out = [_Document(self.with_groups) for _ in texts]
        run, held = [], 0
        for document, text in zip(out, texts, strict=True):
            for part in segments(text) if text else ():
                run.append((document, part))
                held += len(part)
                if held >= RUN_CHARS:
                    self._run(run)
                    run, held = [], 0
        self._run(run)
        return [_Document(self.with_groups) if d.lost else d for d in out]

    def _run(self, parts: list[tuple[_Document, str]]) -> None:
        if not parts:
            return
        units = self.units
        own = units.numbers([part for _, part in parts])
        stops = np.cumsum(list(map(len, own)))
        facts = units.facts.held[np.concatenate(own)].astype(np.int64)
        sums = np.add.reduceat(facts[:, : units.LOST + 1], np.append(0, stops[:-1]), axis=0)
        # each part's distinct pairs and how often it has them
        span = len(units.sizes_a) * units.b.size
        pairs = units.links.held[_spread(facts[:, units.LINK], facts[:, units.LINKS])]
        pairs += np.repeat(np.arange(len(parts)) * span, sums[:, units.LINKS])
        pairs, times = np.unique(pairs, return_counts=True)
        edges = np.searchsorted(pairs, np.arange(len(parts) + 1) * span)
        keys, text_of = pairs % span, units.texts.__getitem__
        for i, (document, _) in enumerate(parts):
            document.lost |= bool(sums[i, units.LOST])
            if document.lost:
                continue
            text = "".join(map(text_of, own[i].tolist()))[:-1]
            document.digest.update(b";" * bool(document.numbers[0]) + text.encode())
            document.numbers += sums[i, : units.BYTES]
            document.keys.append(keys[edges[i] : edges[i + 1]])
            document.times.append(times[edges[i] : edges[i + 1]])
            if document.text is not None:
                document.text.append(text)
                mine = facts[stops[i] - len(own[i]) : stops[i]]
                starts = np.cumsum(mine[:, units.BYTES]) - mine[:, units.BYTES] + document.bytes
                ends = units.ends.held[_spread(mine[:, units.END], mine[:, units.GROUPS])]
                document.cuts.append(ends + np.repeat(starts, mine[:, units.GROUPS]))
            document.bytes += int(sums[i, units.BYTES])
            if len(document.keys) > 16:
                document.pairs()


_COLUMNS = {
    "block": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
    "groups_sha256": pa.string(), "pairs": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "keys": pa.list_(pa.int64()), "held": pa.list_(pa.int32()),
    "groups": pa.string(), "cuts": pa.list_(pa.int64()),
}
_SCHEMA = pa.schema(list(_COLUMNS.items()))
_KIND = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>, "
    "keys array<long>, held array<int>, groups string, cuts array<long>"
)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _rows(**columns: pa.Array | list) -> pa.RecordBatch:
    n = len(columns["block"])
    found = [columns.get(name) for name in _COLUMNS]
    made = [pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(found, _COLUMNS.values(), strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=_SCHEMA)


def _block_rows(block: int, ids: list[int | None], documents: list[_Document]) -> Iterator[pa.RecordBatch]:
    """One row of the block's distinct pairs and how many documents hold each, and a row per document."""
    pairs = [d.pairs() for d in documents]
    keys, held = np.unique(np.concatenate([k for k, _ in pairs]), return_counts=True)
    yield _rows(block=[block], keys=_lists([keys], pa.int64()), held=_lists([held], pa.int32()))
    start, full = 0, np.cumsum([len(k) for k, _ in pairs])
    while start < len(documents):
        base = full[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(full, base + BATCH_PAIRS, "right")))
        part, own = documents[start:stop], pairs[start:stop]
        numbers = np.array([d.numbers for d in part]).T
        found = {name: pa.array(values.copy(), pa.int64()) for name, values in zip(("n_a", "n_b", "n_groups", "n_links"), numbers, strict=True)}
        if part[0].text is not None:
            found |= {"groups": [";".join(d.text) for d in part], "cuts": [np.concatenate(d.cuts) if d.cuts else [] for d in part]}
        yield _rows(
            block=[block] * len(part), doc_id=ids[start:stop], groups_sha256=[d.digest.hexdigest() if d.numbers[0] else "" for d in part],
            pairs=_lists([np.searchsorted(keys, k) for k, _ in own], pa.int32()), times=_lists([t for _, t in own], pa.int32()), **found,
        )
        start = stop


def _aligned(batches: Iterator[pa.RecordBatch], byte_path: str, piece_path: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    aligner = None
    part, blocks, held, ids, documents = TaskContext.get().partitionId(), 0, 0, [], []
    for piece in byte_slices(batches, "text", RUN_CHARS):
        aligner = aligner or Aligner(byte_path, piece_path, with_groups)
        texts = texts_of(piece)
        ids += piece.column("doc_id").to_pylist()
        documents += aligner.documents(texts)
        held += sum(map(len, texts)) + len(texts)
        if held >= BLOCK_BYTES:
            yield from _block_rows(part << 32 | blocks, ids, documents)
            blocks, held, ids, documents = blocks + 1, 0, [], []
    if documents:
        yield from _block_rows(part << 32 | blocks, ids, documents)


def _scored(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with the corpus-wide counts of its pairs."""
    totals, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    at = counts.column("number").to_numpy()
    totals[at], best[at] = counts.column("total").to_numpy(), counts.column("best").to_numpy()
    kept = documents.drop_columns(["block", "pairs", "times"])
    out = {"n_best": np.zeros(0, np.int64), "count_sum": np.zeros(0, np.int64)}
    for batch in documents.to_batches():
        lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
        pairs, sizes = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        for name, of in (("n_best", best), ("count_sum", totals)):
            sums = np.append(0, np.cumsum(times * of[pairs]))
            out[name] = np.append(out[name], np.diff(sums[sizes]))
    for name, values in out.items():
        kept = kept.append_column(name, pa.array(values, pa.int64()))
    return kept


@contextmanager
def _batches_of(rows: int, spark: SparkSession) -> Iterator[None]:
    """Arrow batches of so many rows, as ten thousand texts are held at once by both the JVM and the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, with_groups: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum; with_groups also the groups
    as text and `cuts`, the byte offsets at which they end in a blank and the text.

    Tokens a (byte-level, of a blank and the text) and b (pieces) link where their bytes overlap; a pair's count is the number
    of rows that hold it linked, n_best the links whose count is the highest of their a, count_sum the counts of all links.
    Null and empty texts, and those that the pieces do not give back, have no tokens: zeros and ''. Rows that repeat count
    each; a null doc_id is kept; an empty table gives no rows. Columns beside doc_id and text are not read.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with _batches_of(BATCH_ROWS, docs.sparkSession):
        aligned = materialize(kept.mapInArrow(lambda b: _aligned(b, byte_path, piece_path, with_groups), _KIND), "aligned-tokens")
    blocks = aligned.filter("keys IS NOT NULL").select(F.col("block").alias("of_block"), F.posexplode(F.arrays_zip("keys", "held")).alias("number", "pair"))
    blocks = blocks.select("of_block", "number", F.col("pair.keys").alias("key"), F.col("pair.held").alias("held"))
    size = _piece_count(piece_path)
    totals = blocks.groupBy("key").agg(F.sum("held").alias("total"))
    highest = F.max("total").over(Window.partitionBy(F.expr(f"key DIV {size}L")))
    totals = totals.select("key", "total", (F.col("total") == highest).cast("long").alias("best"))
    counts = blocks.join(totals, "key").select("of_block", "number", "total", "best")
    more = ["groups", "cuts"] if with_groups else []
    documents = aligned.filter("keys IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *more, "pairs", "times")
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + (", groups string, cuts array<long>" if more else "")
    return documents.groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(_scored, f"{kinds}, n_best long, count_sum long")


def _piece_count(piece_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).vocab_size()


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts of tokens, groups and links, and groups_sha256 of every document: align_tokenizers."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
