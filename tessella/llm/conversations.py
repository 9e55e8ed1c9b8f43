"""Repair of conversations by the cheapest edits, by a Viterbi pass whose chunks run side by side and converge in rank.

Rows are sorted by conversation and turn over all tasks, so that one conversation may lie in many. A conversation that lies
whole in a task, and is no longer than a chunk, is repaired there. Others are cut into chunks. Each chunk computes its costs
backward from a speculative vector, as if it were the last one; then fix-up passes hand each chunk its successor's vector and
rerun it until its vectors differ from the earlier ones by constants only, which mostly takes a few rows. When no chunk's
first vector changes any more, the stitched costs lead the least audit forward through the chunks in order.

A state is what the roles kept so far end with: nothing, system, user or assistant.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.batches import byte_slices
from tessella.llm.picking import join_hot, pick
from tessella.storage import materialize

#: A chunk ends with so many rows or bytes of text, whichever come first.
CHUNK_ROWS, CHUNK_BYTES = 1 << 16, 4 << 20
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLANKS = " \t\n\v\f\r"
# Kinds of role by their first character; what a row is; states.
KINDS, OTHER = {"s": 0, "u": 1, "a": 2}, 3
FINE, CUT, GONE = 0, 1, 2
FOLLOWS = {(0, 1), (1, 2), (2, 1)}
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or changed row, and after a kept one of each kind.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {(NOTHING, 0): SYSTEM, (NOTHING, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
NEVER = 1 << 20

Vector = tuple[int, ...]


def _with_inserts(costs: list[int]) -> Vector:
    user, assistant = costs[USER], costs[ASSISTANT]
    costs[USER], costs[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
    for state in (NOTHING, SYSTEM):
        costs[state] = min(costs[state], INSERT + costs[USER])
    return tuple(costs)


#: Costs after the last row: nothing, or an assistant's turn, may end.
LAST = _with_inserts([0, NEVER, NEVER, 0])


def _moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of a row, in the edits' ASCII order."""
    kind, fault = divmod(code, 3)
    moves = [("D", DELETE, state)]
    if fault != GONE:
        if (state, kind) in KEPT:
            moves.append(("K", fault * TRUNCATED, KEPT[state, kind]))
        moves.append(("R", REROLE + fault * TRUNCATED, NEXT[state]))
    return moves


@cache
def _raw(after: Vector, code: int) -> Vector:
    return _with_inserts([min(cost + after[to] for _, cost, to in _moves(code, state)) for state in range(4)])


@cache
def step(after: Vector, code: int) -> Vector:
    """The costs before a row from those after it, less their least: there are few such vectors."""
    costs = _raw(after, code)
    return tuple(c - min(costs) for c in costs)


@cache
def trace(after: Vector, code: int, state: int) -> tuple[str, int, int]:
    """The least of the cheapest edits at a row and before it, their cost, and the state after it."""
    costs, edits, spent = _raw(after, code), "", 0
    while True:
        for edit, cost, to in _moves(code, state)[:1]:
            if cost + after[to] == costs[state]:
                return edits + edit, spent + cost, to
        if INSERT + costs[NEXT[state]] == costs[state]:
            edits, spent, state = edits + "I", spent + INSERT, NEXT[state]
            continue
        for edit, cost, to in _moves(code, state)[1:]:
            if cost + after[to] == costs[state]:
                return edits + edit, spent + cost, to


def vectors_of(codes: bytes, last: Vector = LAST, known: np.ndarray | None = None) -> np.ndarray:
    """The vector before each row and after the last, from `last` backward.

    With `known`, those of an earlier run, it stops where the vectors agree, which they do from there on: vectors are kept
    less their least, so agreement means a constant between the costs.
    """
    out = np.empty((len(codes) + 1, 4), np.uint8) if known is None else known.copy()
    out[len(codes)] = now = tuple(c - min(last) for c in last)
    for i in range(len(codes) - 1, -1, -1):
        now = step(now, codes[i])
        if known is not None and tuple(known[i].tolist()) == now:
            break
        out[i] = now
    return out


class Facts(NamedTuple):
    """Counts of a run of rows; two runs that follow each other add up to one."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_kind: int | None = None
    last_kind: int | None = None
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0

    def then(self, other: Facts) -> Facts:
        crossing = self.last_kind is not None and other.first_kind is not None and (self.last_kind, other.first_kind) not in FOLLOWS
        same = self.last_turn is not None and self.last_turn == other.first_turn
        return Facts(
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated, self.illegal + other.illegal + crossing,
            other.first_kind if self.first_kind is None else self.first_kind, self.last_kind if other.last_kind is None else other.last_kind,
            other.first_turn if self.first_turn is None else self.first_turn, self.last_turn if other.last_turn is None else other.last_turn,
            self.turns + other.turns - same,
        )

    def gaps(self) -> int:
        return 0 if self.turns == 0 else min(self.last_turn - self.first_turn + 1 - self.turns, (1 << 63) - 1)


class Repaired:
    """Edits of one conversation, chunk after chunk; rows of a deleted turn need no text."""

    def __init__(self) -> None:
        self.state, self.cost, self.edits, self.digest, self.facts, self.rows = NOTHING, 0, [], hashlib.sha256(), Facts(), 0

    def _turn(self, role: str, text: str) -> tuple[str, str]:
        self.digest.update(f"{chr(10) * bool(self.rows)}{role}:{text}".encode())
        self.rows += 1
        return role, text

    def add(self, facts: Facts, codes: bytes, roles: list[str], texts: list[str], vectors: np.ndarray) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) of a chunk's rows and of those inserted between them."""
        self.facts = self.facts.then(facts)
        after, at = list(map(tuple, vectors.tolist())), 0
        for i, code in enumerate(codes):
            edits, spent, to = trace(after[i + 1], code, self.state)
            self.cost += spent
            self.edits.append(edits)
            for edit in edits[:-1]:
                self.state = NEXT[self.state]
                yield edit, *self._turn(_role(self.state), "")
            if edits[-1] == "D":
                yield "D", None, None
            else:
                role = roles[at] if edits[-1] == "K" else _role(to)
                yield edits[-1], *self._turn(role, texts[at])
            at, self.state = at + (code % 3 != GONE), to

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.state not in (NOTHING, ASSISTANT):
            self.cost, self.state = self.cost + INSERT, NEXT[self.state]
            self.edits.append("I")
            yield "I", *self._turn(_role(self.state), "")

    def summary(self) -> tuple:
        f = self.facts
        return f.gaps(), f.blank, f.duplicate, f.truncated, f.illegal, self.cost, "".join(self.edits), self.digest.hexdigest()


def _role(state: int) -> str:
    return "user" if state == USER else "assistant"


class _Chunk:
    """Rows of one conversation that follow each other, coded, with the texts of those that may stay."""

    def __init__(self) -> None:
        self.facts, self.codes, self.roles, self.texts, self.bytes = Facts(), bytearray(), [], [], 0

    def add(self, turn: int | None, role: str, text: str, later: bool) -> None:
        kind, bare = KINDS.get(role[:1], OTHER), text.strip(BLANKS)
        truncated = bool(bare) and not later and bare[-1] not in ".!?"
        fault = GONE if later or not bare else CUT if truncated else FINE
        own = (not bare, bool(bare) and later, truncated)
        self.facts = self.facts.then(Facts(*own, 0, kind, kind, turn, turn, turn is not None))
        self.codes.append(kind * 3 + fault)
        if fault != GONE:
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(role) + len(text)

    def full(self) -> bool:
        return len(self.codes) >= CHUNK_ROWS or self.bytes >= CHUNK_BYTES


_FACTS = [(name, pa.int64()) for name in Facts._fields]
_DONE = [(name, pa.int64()) for name in ("gaps", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
_TURN = [("number", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
_KEYS = [("known", pa.bool_()), ("conv", pa.int64())]
_CODES = [("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("vectors", pa.binary())]
_CHUNKS = pa.schema([*_KEYS, ("part", pa.int64()), ("place", pa.int64()), ("cut", pa.bool_()), *_FACTS, *_CODES, *_DONE])
_SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_NAMES = {pa.bool_(): "boolean", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.string()): "array<string>"}


def _ddl(schema: pa.Schema | list) -> str:
    return ", ".join(f"{f.name} {_NAMES[f.type]}" for f in pa.schema(schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _batched(rows: Iterable[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 100 + size(row)
        if n >= CHUNK_BYTES:
            yield _batch(held, schema)
            held, n = [], 0
    if held:
        yield _batch(held, schema)


def _chunk_rows(batches: Iterator[pa.RecordBatch], stitch_all: bool) -> Iterator[tuple]:
    part, place, key, first, cut, chunk = TaskContext.get().partitionId(), 0, None, None, True, _Chunk()

    def row(whole: bool) -> tuple:
        codes = bytes(chunk.codes)
        vectors = vectors_of(codes)
        if not whole:
            return (*key, part, place, True, *chunk.facts, codes, chunk.roles, chunk.texts, vectors.tobytes(), None, None, None, None)
        done = Repaired()
        for _ in (*done.add(chunk.facts, codes, chunk.roles, chunk.texts, vectors), *done.end()):
            pass
        gaps, *_, cost, audit, digest = done.summary()
        return (*key, part, place, False, *chunk.facts, None, None, None, None, gaps, cost, audit, digest)

    columns = ("known", "conv", "turn", "role", "text", "copies", "later")
    for batch in byte_slices(batches, "text"):
        for known, conv, turn, role, text, copies, later in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if (known, conv) != key:
                if key is not None:
                    yield row(not cut)
                    place += 1
                first = first or (known, conv)
                key, chunk, cut = (known, conv), _Chunk(), stitch_all or first == (known, conv)  # the first may have begun in another task
            for i in range(copies):
                if chunk.full():
                    cut = True
                    yield row(False)
                    place, chunk = place + 1, _Chunk()
                chunk.add(turn, role, text, later or i > 0)
    if key is not None:
        yield row(False)  # the last may go on in another task


def _coded(batches: Iterator[pa.RecordBatch], stitch_all: bool) -> Iterator[pa.RecordBatch]:
    return _batched(_chunk_rows(batches, stitch_all), _CHUNKS, lambda r: sum(map(len, r[16] or ())) + len(r[14] or b"") * 5)


def _rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their successor's first vector: the vectors that follow from it, and whether the first one changed."""
    for batch in byte_slices(batches, "vectors"):
        rows = []
        for known, conv, g, codes, vectors, head in zip(*(batch.column(c).to_pylist() for c in ("known", "conv", "g", "codes", "vectors", "head")), strict=True):
            old = np.frombuffer(vectors, np.uint8).reshape(-1, 4)
            last = LAST if head is None else tuple(head)
            new = old if tuple(old[-1].tolist()) == last else vectors_of(codes, last, old)
            rows.append((known, conv, g, codes, new.tobytes(), new[:1].tobytes() != old[:1].tobytes()))
        yield _batch(rows, _PASSED)


_PASSED = pa.schema([*_KEYS, ("g", pa.int64()), ("codes", pa.binary()), ("vectors", pa.binary()), ("changed", pa.bool_())])


def _converged(chunks: DataFrame) -> DataFrame:
    """(g, vectors) of chunks numbered by g, after fix-up passes; each writes its chunks' codes and vectors, no texts."""
    now = materialize(chunks.select("known", "conv", "g", "codes", "vectors", F.lit(True).alias("changed")), "fix-up")
    while True:
        heads = now.select((F.col("g") - 1).alias("g"), F.col("known").alias("k"), F.col("conv").alias("c"), F.expr("substring(vectors, 1, 4)").alias("head"))
        head = F.when((F.col("k") == F.col("known")) & (F.col("c") == F.col("conv")), F.col("head")).alias("head")
        both = now.join(heads, "g", "left").select("known", "conv", "g", "codes", "vectors", head)
        now = materialize(both.mapInArrow(_rerun, _ddl(_PASSED)), "fix-up")
        if not now.agg(F.coalesce(F.bool_or("changed"), F.lit(False))).first()[0]:
            return now.select("g", "vectors")


def _conversations(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[tuple]:
    """Chunks in order, one conversation after another: a row for each turn, or for each conversation."""
    key, done, number = None, Repaired(), 0

    def out(edits: Iterator[tuple]) -> Iterator[tuple]:
        nonlocal number
        for edit in edits:
            number += 1
            if turns:
                yield (*key, number, *edit)

    for batch in byte_slices(batches, "codes", 1 << 16):
        columns = [batch.column(c).to_pylist() for c in ("known", "conv", *Facts._fields, "codes", "roles", "texts", "vectors")]
        for known, conv, *facts, codes, roles, texts, vectors in zip(*columns, strict=True):
            if (known, conv) != key:
                if key is not None:
                    yield from out(done.end())
                    yield from () if turns else ((*key, *done.summary()),)
                key, done, number = (known, conv), Repaired(), 0
            yield from out(done.add(Facts(*facts), codes, roles, texts, np.frombuffer(vectors, np.uint8).reshape(-1, 4)))
    if key is not None:
        yield from out(done.end())
        yield from () if turns else ((*key, *done.summary()),)


_SUMMARIES = pa.schema([*_KEYS, *((n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in _SUMMARY)])
_TURNS = pa.schema([*_KEYS, *_TURN])


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and whether an earlier turn has the same role and text, sorted over all tasks."""
    said, place = ["known", "conv", "role", "sign"], F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    clean = rows.select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), copies.alias("copies"),
    )
    one = clean.groupBy("known", "conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    one = materialize(one.withColumn("sign", F.sha2("text", 256)), "turns")
    spread = one.filter("copies > 0").groupBy(*said).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("rows"))
    spread = materialize(spread.filter("first <> last").select(*said, "first", "rows"), "said-again")
    usual = pick(one, spread, said, "left_anti").withColumn("later", F.lit(False))
    again = join_hot(one, spread, said, "rows").withColumn("later", F.col("first") < place).select(*usual.columns)
    order = ["known", "conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), "sign"]
    return usual.unionByName(again).repartitionByRange(*order).sortWithinPartitions(*order).drop("sign")


def _numbered(rows: DataFrame, stitch_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chunks of the rows: those of conversations repaired within a task, and the others numbered by g in their order."""
    chunks = _sorted_rows(rows).mapInArrow(lambda b: _coded(b, stitch_all), _ddl(_CHUNKS))
    chunks = materialize(chunks, "conversation-chunks")
    sizes = chunks.groupBy("part").agg((F.max("place") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row per task of the sort
    cut = chunks.filter("cut").join(F.broadcast(offsets), "part").withColumn("g", F.col("before") + F.col("place"))
    return chunks.filter("NOT cut"), cut


def _stitched(cut: DataFrame, turns: bool) -> DataFrame:
    """Whole conversations of their chunks, streamed in order: one task holds one chunk of a conversation at a time."""
    both = cut.drop("vectors").join(_converged(cut), "g").repartition("known", "conv").sortWithinPartitions("known", "conv", "g")
    schema = _TURNS if turns else _SUMMARIES
    return both.mapInArrow(lambda b: _batched(_conversations(b, turns), schema, lambda r: len(r[-1] or "") + len(r[-2] or "")), _ddl(schema))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Per conv_id of `rows` (conv_id, turn, role, text; optionally copies, how often each row stands there, 0 for none):
    gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Null roles and texts are a blank, null conv_ids one conversation. Rows go by turn, nulls first, then by role, the text's
    first 64 characters and its SHA-256. A conversation of no rows has zeros, an empty audit and the digest of nothing; no
    rows at all give none; columns of other names are not read.
    """
    whole, cut = _numbered(rows)
    columns = [F.when(F.col("known"), F.col("conv")).alias("conv_id"), *_SUMMARY]
    return whole.select(*columns).unionByName(_stitched(cut, False).select(*columns))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The edits themselves, (conv_id, number, edit, role, text) in order by number: kept, changed and inserted turns with their
    role and text, deleted ones without. Rows and nulls are read as repair_conversations reads them.
    """
    _, cut = _numbered(rows, stitch_all=True)
    return _stitched(cut, True).select(F.when(F.col("known"), F.col("conv")).alias("conv_id"), "number", "edit", "role", "text")


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` with faults put in by crc32(conv_id:turn) mod 20, as rows of conv_id, turn, role, text and copies.

    0 drops a row (no copies), 1 empties its text, 2 removes its full stops and marks, 3 doubles it, 4 makes it the user's.
    """
    number, text, role = (F.coalesce(c, F.lit(" ")) for c in (F.col("turn").cast("string"), F.col("text"), F.col("role")))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), number)
    fault: Column = F.crc32(key.cast("binary")) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """conv_id, counts of faults, cost, audit and repaired_sha256 of every conversation, after damage."""
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP11_SQL = r"""
WITH RECURSIVE
checks AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(n))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce([ascii(x) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')],
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295)) % 20 AS fault
  FROM conversations, checks),
faulty AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM faulty),
marked AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, substr(role, 1, 1) AS k,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
paths AS (
  SELECT conv_id, 0 AS i, {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} AS z, {'c': 99999999, 'a': '', 'r': CAST([] AS VARCHAR[])} AS s,
    {'c': 99999999, 'a': '', 'r': CAST([] AS VARCHAR[])} AS u, {'c': 99999999, 'a': '', 'r': CAST([] AS VARCHAR[])} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i,
    {'c': z.c + 3, 'a': z.a || 'D', 'r': z.r},
    least({'c': s.c + 3, 'a': s.a || 'D', 'r': s.r},
      {'c': CASE WHEN stays AND k = 's' THEN z.c + extra ELSE 99999999 END, 'a': z.a || 'K', 'r': list_append(z.r, role || ':' || text)}),
    least({'c': u.c + 3, 'a': u.a || 'D', 'r': u.r},
      {'c': CASE WHEN NOT stays THEN 99999999 WHEN k = 'u' THEN v.c + extra ELSE v.c + extra + 2 END, 'a': v.a || CASE k WHEN 'u' THEN 'K' ELSE 'R' END,
        'r': list_append(v.r, CASE k WHEN 'u' THEN role ELSE 'user' END || ':' || text)}),
    least({'c': a.c + 3, 'a': a.a || 'D', 'r': a.r},
      {'c': CASE WHEN NOT stays THEN 99999999 WHEN k = 'a' THEN u.c + extra ELSE u.c + extra + 2 END, 'a': u.a || CASE k WHEN 'a' THEN 'K' ELSE 'R' END,
        'r': list_append(u.r, CASE k WHEN 'a' THEN role ELSE 'assistant' END || ':' || text)})
  FROM (
    SELECT conv_id, i, z, s, u, least(a, {'c': u.c + 2, 'a': u.a || 'I', 'r': list_append(u.r, 'assistant:')}) AS a, least(z, s,
        least(a, {'c': u.c + 2, 'a': u.a || 'I', 'r': list_append(u.r, 'assistant:')})) AS v, role, text, k, stays, extra
    FROM (
      SELECT p.conv_id, m.i, p.z, p.s, p.a, m.role, m.text, m.k, m.fault NOT IN ('blank', 'duplicate') AS stays,
        CASE m.fault WHEN 'truncated' THEN 1 ELSE 0 END AS extra,
        least(p.u, {'c': p.z.c + 2, 'a': p.z.a || 'I', 'r': list_append(p.z.r, 'user:')}, {'c': p.s.c + 2, 'a': p.s.a || 'I', 'r': list_append(p.s.r, 'user:')},
          {'c': p.a.c + 2, 'a': p.a.a || 'I', 'r': list_append(p.a.r, 'user:')}) AS u
      FROM paths p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1))),
ends AS (
  SELECT conv_id, least(z, a, {'c': u.c + 2, 'a': u.a || 'I', 'r': list_append(u.r, 'assistant:')},
      {'c': s.c + 4, 'a': s.a || 'II', 'r': list_concat(s.r, ['user:', 'assistant:'])}) AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM paths) WHERE back = 1)
SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(e.c AS BIGINT) AS cost, e.a AS audit,
  sha256(array_to_string(e.r, chr(10))) AS repaired_sha256
FROM ends LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ends.conv_id
"""
