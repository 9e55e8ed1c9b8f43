"""Sampled SentencePiece segmentation: forward filtering over the piece lattice, backward sampling by a seeded stream.

The model's pieces never span a space except at their start, so the lattice of a text falls into one lattice for each
space-led chunk. Forward sums are computed once for each distinct chunk of a batch; every occurrence then draws its own
path from the chunk's end, one uniform number per piece, from a counter-based generator keyed by the row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from math import exp
from math import log as ln

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import byte_slices, texts_of

SPACE = "▁"
#: Merge ranks stand in for unigram probabilities by Zipf's law: log p = -SHARPNESS * log(rank + ZIPF_OFFSET) - LEVEL.
ZIPF_OFFSET, LEVEL, SHARPNESS = 50.0, 2.0, 1.0
#: Log probability of each byte of a character that is no piece.
BYTE_LOG = -12.0
SEED = 20240607
_CHUNK = re.compile(r" ?[^ \n]+|[ \n]")
_STEP, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Distinct chunks whose lattices are computed side by side.
GROUP = 1 << 16
#: Chunks of more characters are summed one by one.
LONG = 64
_HASH_BASE = 0x2545F4914F6CDD1D
_NO_PIECE = np.uint32(0x110000)


class PieceLattice:
    """A piece model's tables: pieces found by length and hash, their log probabilities and bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.bytes_of = [b""] * n
        normal, self.byte_id = [], np.zeros(256, np.int64)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or SPACE in piece[1:]):
                normal.append((i, piece, -model.get_score(i)))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(len(p) for _, p, _ in normal)
        self.base = np.uint64(_HASH_BASE)
        self.powers = np.array([pow(_HASH_BASE, i, 1 << 64) for i in range(self.longest + 1)], dtype=np.uint64)
        keys = self._mix(np.array([_polynomial(p) for _, p, _ in normal], dtype=np.uint64), [len(p) for _, p, _ in normal])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for i, _, _ in normal])[order]
        ranks = np.array([r for _, _, r in normal])[order]
        self.logs = -SHARPNESS * np.log(np.maximum(ranks, 0) + ZIPF_OFFSET) - LEVEL
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces share a hash")
        # first look in a table by the hash's top bits, where nearly every piece has a slot of its own
        self.slot = np.full(1 << 20, -1, np.int32)
        slots = (self.keys >> np.uint64(44)).astype(np.int64)
        self.slot[slots[::-1]] = np.arange(len(self.keys), dtype=np.int32)[::-1]
        self.shared = np.zeros(1 << 20, bool)
        values, counts = np.unique(slots, return_counts=True)
        self.shared[values[counts > 1]] = True

    @staticmethod
    def _mix(h: np.ndarray, size) -> np.ndarray:
        h = h + np.asarray(size, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return h ^ (h >> np.uint64(29))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key among the pieces, -1 where it is none."""
        slots = (keys >> np.uint64(44)).astype(np.int64)
        at = self.slot[slots].astype(np.int64)
        at[(at >= 0) & (self.keys[at] != keys) & ~self.shared[slots]] = -1
        doubt = np.flatnonzero(self.shared[slots])
        if len(doubt):
            found = np.minimum(np.searchsorted(self.keys, keys[doubt]), len(self.keys) - 1)
            at[doubt] = np.where(self.keys[found] == keys[doubt], found, -1)
        return at

    def filter_forward(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """The lattices of distinct chunks: each chunk's last node and first node; then, edge by edge in the order of
        the nodes they end at: the end node plus the cumulative probability, the start node, the piece (below 0: minus a
        character that is no piece).

        Chunks go by length, longest first, and nodes by depth: at each depth the chunks that reach it are a prefix, so
        every step is an operation on whole slices.
        """
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        last, first = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        bounds, origins, pieces, used = [], [], [], 0
        by_size = np.argsort(-sizes, kind="stable")
        long = int((sizes > LONG).sum())
        for j in by_size[:long].tolist():
            first[j], last[j] = used, used + sizes[j]
            used = self._filter_long(chunks[j], used, bounds, origins, pieces)
        for i in range(long, len(chunks), GROUP):
            group = by_size[i : i + GROUP]
            used = self._filter_group([chunks[j] for j in group], sizes[group], used, group, last, first, bounds, origins, pieces)
        return last, first, np.concatenate(bounds), np.concatenate(origins), np.concatenate(pieces)

    def _filter_long(self, chunk, used, bounds, origins, pieces) -> int:
        """One long chunk: its edges found at all places at once, its sums taken place by place."""
        codes = self._codes([chunk])
        n = len(codes)
        spread = (codes.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xD6E8FEB86659FD93)
        hashes, stops, sizes, logs, ids = np.zeros(n, np.uint64), [], [], [], []
        for size in range(1, min(self.longest, n) + 1):
            hashes = hashes[: n - size + 1] * self.base + spread[size - 1 :]
            at = self._find(self._mix(hashes, size))
            hit = np.flatnonzero(at >= 0)
            stops.append(hit + size)
            sizes.append(np.full(len(hit), size))
            logs.append(self.logs[at[hit]])
            ids.append(self.ids[at[hit]])
            if size == 1:
                miss = np.flatnonzero(at < 0)
                width, piece = self._spelt(codes[miss])
                stops.append(miss + 1)
                sizes.append(np.ones(len(miss), np.int64))
                logs.append(BYTE_LOG * width)
                ids.append(piece)
        stop, size, log, piece = (np.concatenate(x) for x in (stops, sizes, logs, ids))
        order = np.argsort(stop, kind="stable")
        stop, size, log, piece = stop[order], size[order], log[order], piece[order]
        heads = np.searchsorted(stop, np.arange(n + 2)).tolist()
        start, weight = (stop - size).tolist(), log.tolist()
        alpha, share = [0.0] * (n + 1), np.empty(len(stop))
        for k in range(1, n + 1):
            a, b = heads[k], heads[k + 1]
            here = [alpha[i] + w for i, w in zip(start[a:b], weight[a:b], strict=True)]
            top, running = max(here), 0.0
            for i, x in enumerate(here, a):
                running += exp(x - top)
                share[i] = running
            share[a:b] /= running
            share[b - 1] = 1.0
            alpha[k] = top + ln(running)
        bounds.append(used + stop + share)
        origins.append(used + stop - size)
        pieces.append(piece)
        return used + n + 1

    @staticmethod
    def _codes(chunks: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(codes == 0x2581, _NO_PIECE, np.where(codes == 0x20, 0x2581, codes)).astype(np.int64)

    def _spelt(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of characters that are no piece, and the byte's piece or, of several bytes, minus the character."""
        c = np.where(codes == _NO_PIECE, 0x2581, codes)
        width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        return width, np.where(width == 1, self.byte_id[c & 0xFF], -c)

    def _filter_group(self, chunks, sizes, used, group, last, first, bounds, origins, pieces) -> int:
        codes = self._codes(chunks)
        starts = np.cumsum(sizes) - sizes
        longest = int(sizes[0])
        reach = np.searchsorted(-sizes, -np.arange(longest + 1), "right")  # chunks of at least so many characters
        offset = used + np.cumsum(reach) - reach
        first[group] = offset[0] + np.arange(len(chunks))
        last[group] = offset[sizes] + np.arange(len(chunks))
        hashes, alpha = [np.zeros(len(chunks), np.uint64)], [np.zeros(len(chunks))]
        for k in range(1, longest + 1):
            n = reach[k]
            code = codes[starts[:n] + k - 1]
            hashes.append(hashes[-1][:n] * self.base + (code.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xD6E8FEB86659FD93))
            depth = min(self.longest, k)
            logs, ids = np.full((n, depth), -np.inf), np.empty((n, depth), np.int64)
            for size in range(1, depth + 1):
                at = self._find(self._mix(hashes[k] - hashes[k - size][:n] * self.powers[size], size))
                hit = np.flatnonzero(at >= 0)
                found = at[hit]
                logs[hit, size - 1] = alpha[k - size][hit] + self.logs[found]
                ids[hit, size - 1] = self.ids[found]
                if size == 1 and len(hit) < n:
                    miss = np.flatnonzero(at < 0)
                    width, ids[miss, 0] = self._spelt(code[miss])
                    logs[miss, 0] = alpha[k - 1][miss] + BYTE_LOG * width
            top = logs.max(axis=1)
            running = np.cumsum(np.exp(logs - top[:, None]), axis=1)
            total = running[:, -1]
            alpha.append(top + np.log(total))
            row, col = np.nonzero(logs > -np.inf)
            share = running[row, col] / total[row]
            share[np.r_[row[1:] != row[:-1], True]] = 1.0
            bounds.append(row + offset[k] + share)
            origins.append(offset[k - col - 1] + row)
            pieces.append(ids[row, col])
        return int(offset[-1] + reach[-1])

    def sample(self, texts: list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 offsets; `keys` seeds each text's own stream."""
        found = [_CHUNK.findall(f" {t}") if t else [] for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = [c for chunks in found for c in chunks]
        if not flat:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        chunks = list(dict.fromkeys(flat))
        number = dict(zip(chunks, range(len(chunks)), strict=True))
        which = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        last_node, first_node, bound, e_from, e_id = self.filter_forward(chunks)
        near = np.argsort(last_node[which], kind="stable")  # occurrences of a chunk side by side, for the cache's sake
        text_of = np.repeat(np.arange(len(texts)), counts)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        stream = _scramble(keys[text_of] ^ _scramble(within.astype(np.uint64) + np.uint64(seed)))
        alive = near
        node, stop = last_node[which[near]], first_node[which]
        steps, owners, pieces = np.zeros(len(flat), np.int64), [], []
        turn = 0
        while len(alive):
            uniform = (_scramble(stream[alive] + np.uint64(turn * _STEP & _ALL)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = np.searchsorted(bound, node + np.minimum(uniform, 1 - 1e-9), "right")
            owners.append(alive)
            pieces.append(e_id[edge])
            steps[alive] += 1
            node = e_from[edge]
            go = node > stop[alive]
            alive, node, turn = alive[go], node[go], turn + 1
        ends = np.cumsum(steps)
        out = np.empty(int(ends[-1]), np.int64)
        for turn, (owner, piece) in enumerate(zip(owners, pieces, strict=True)):
            out[ends[owner] - 1 - turn] = piece
        per_text = np.r_[0, np.cumsum(np.bincount(text_of, weights=steps, minlength=len(texts)))].astype(np.int64)
        return self._with_bytes(out, per_text)

    def _with_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece, as their bytes' pieces."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, offsets
        spelt = [[int(self.byte_id[b]) for b in chr(-c).encode("utf-8", "surrogatepass")] for c in ids[odd].tolist()]
        width = np.ones(len(ids), np.int64)
        width[odd] = [len(x) for x in spelt]
        ends = np.cumsum(width)
        out = np.repeat(ids, width)
        for i, x in zip(odd, spelt, strict=True):
            out[ends[i] - len(x) : ends[i]] = x
        return out, np.r_[0, ends][offsets]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; the space that starts every text is no part of it."""
        pieces = self.bytes_of
        return b"".join([pieces[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def _polynomial(piece: str) -> int:
    total = 0
    for c in map(ord, piece):
        total = (total * _HASH_BASE + (c + 0x51ED27) * 0xD6E8FEB86659FD93) & _ALL
    return total


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def lattice(path: str) -> PieceLattice:
    return PieceLattice(path)


def encode_sampled(docs: DataFrame, model_path: str, seed: int = SEED) -> DataFrame:
    """Per row of `docs`: doc_id and piece_ids, a segmentation drawn from the lattice.

    The draw depends on the seed, the doc_id and the text alone, so it is the same however rows are dealt and tasks
    repeated; equal rows get equal segmentations. A null doc_id draws as if it were 0. Null and empty texts have no
    pieces. Other columns are left out. A narrow pass without shuffle.
    """

    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _encoded(batches, model_path, seed, False), "doc_id long, piece_ids array<int>"
    )


def _encoded(batches: Iterator[pa.RecordBatch], model_path: str, seed: int, checked: bool) -> Iterator[pa.RecordBatch]:
    table = lattice(model_path)
    for batch in byte_slices(batches, "text"):
        docs, texts = batch.column("doc_id").cast(pa.int64()), texts_of(batch)
        keys = docs.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        ids, offsets = table.sample(texts, _scramble(keys), seed)
        columns = [docs, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))]
        if checked:
            back = [table.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns += [pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]), pa.array([a == b for a, b in zip(texts, back, strict=True)])]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece_ids", "text_sha256", "lossless"][: len(columns)])


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and piece_ids; null and empty piece_ids give an empty text."""

    return encoded.select("doc_id", "piece_ids").mapInArrow(lambda batches: _decoded(batches, model_path), "doc_id long, text string")


def _decoded(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    table = lattice(model_path)
    for batch in batches:
        texts = [table.decode(np.array(ids or [], np.int64)) for ids in batch.column("piece_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def round_trips(docs: DataFrame, model_path: str, seed: int = SEED) -> DataFrame:
    """encode_sampled with, in the same pass, text_sha256 of the decoded text and lossless: whether it is the text."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _encoded(batches, model_path, seed, True), "doc_id long, piece_ids array<int>, text_sha256 string, lossless boolean"
    )


def op10_piece_sampling(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, piece_ids, text_sha256 of the decoded text, and lossless."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = round_trips(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "text_sha256", "lossless")
