import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessella.llm import conversations as c
from tessella.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, copies long"


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if v is None else v for v in (role, text))
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if n == 1 else "".join(x for x in text if x not in ".!?") if n == 2 else text
        out.append((conv, turn, "user" if n == 4 else role, text, {0: 0, 3: 2}.get(n, 1)))
    return out


def best_edits(rows, legal_after={"": "su", "s": "u", "u": "a", "a": "u"}):
    """Forward: the least (cost, audit, turns) for each role that a repaired beginning ends with."""
    roles = {"u": "user", "a": "assistant"}

    def inserted(paths):
        for _ in range(4):
            for end, (cost, audit, turns) in list(paths.items()):
                for r in legal_after[end].replace("s", ""):
                    new = (cost + 2, audit + "I", turns + (f"{roles[r]}:",))
                    paths[r] = min(paths.get(r, new), new)
        return paths

    paths = inserted({"": (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for end, (cost, audit, turns) in paths.items():
            tries = [(end, 3, "D", turns)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[:1] in legal_after[end]:
                    tries.append((role[:1], more, "K", (*turns, f"{role}:{text}")))
                tries += [(r, 2 + more, "R", (*turns, f"{roles[r]}:{text}")) for r in legal_after[end].replace("s", "")]
            for to, price, edit, result in tries:
                new[to] = min(new.get(to, (1 << 30,)), (cost + price, audit + edit, result))
        paths = inserted(new)
    return min(paths[e] for e in ("", "a") if e in paths)


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text, copies in rows:
        role, text = (" " if v is None else v for v in (role, text))
        groups[conv] += [(turn is not None, turn or 0, role, text)] * copies
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0], r[1], r[2], r[3][:64], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, marked = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            marked.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for known, t, *_ in own if known}
        kinds = [m[0][:1] for m in marked]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(kinds, kinds[1:], strict=False))
        cost, audit, result = best_edits(marked)
        faults = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(result).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()), key=repr)


def made(n, most, seed, odd=True):
    random.seed(seed)
    roles = ["user", "assistant", "user", "assistant", "system", *(["tool", "", None, "s", "ü"] if odd else [])]
    texts = ["Yes.", "no", "One? ", "", " \t", "Two!\n", "é.", "a longer turn.", *([None] if odd else [])]
    rows = []
    for conv in range(n):
        for turn in range(random.randint(1, most)):
            turn = None if odd and random.random() < 0.05 else turn + random.randint(0, 1)
            rows.append((None if odd and conv == 3 else conv, turn, random.choice(roles), random.choice(texts), random.choice([0, 1, 1, 1, 1, 2])))
    return rows


@pytest.mark.parametrize(("rows", "size"), [(1 << 16, 4 << 20), (3, 4 << 20), (1 << 16, 20)])
def test_like_brute_force(spark, monkeypatch, rows, size):
    monkeypatch.setattr(c, "CHUNK_ROWS", rows)
    monkeypatch.setattr(c, "CHUNK_BYTES", size)
    data = made(150, 12, rows + size) + made(1, 300, 4)
    frame = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert found(c.repair_conversations(frame)) == brute(data)


def test_turns_are_the_edits(spark, monkeypatch):
    monkeypatch.setattr(c, "CHUNK_ROWS", 4)
    data = made(40, 10, 8)
    frame = spark.createDataFrame(data, SCHEMA)
    turns = defaultdict(list)
    for r in c.repaired_turns(frame).orderBy("number").collect():
        turns[r.conv_id].append(r)
    for conv, *_, audit, digest in brute(data):
        own = turns[conv]
        assert "".join(r.edit for r in own) == audit and [r.number for r in own] == list(range(1, len(own) + 1))
        text = "\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == digest


def test_a_third_of_all_rows_in_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(c, "CHUNK_ROWS", 50)
    random.seed(1)
    data = [(7, i, random.choice(["user", "assistant"]), random.choice(["Ok.", f"Turn {i}.", "cut"]), 1) for i in range(2000)]
    data += [(8, 0, "user", "The same row.", 1)] * 700 + [(9, i, "system", "", 1) for i in range(500)] + made(100, 8, 6)[300:]
    data += [(10, i, "ua"[i % 2].replace("u", "user").replace("a", "assistant"), f"Turn {i}.", 1) for i in range(401)]
    frame = spark.createDataFrame(data, SCHEMA).repartition(6)
    assert found(c.repair_conversations(frame)) == brute(data)


def test_reruns_stop_where_vectors_are_parallel():
    random.seed(2)
    codes = bytes(random.randrange(12) for _ in range(500))
    speculative = c.vectors_of(codes)
    for last in ((0, 1, 2, 3), (0, 4, 2, 0), (3, 0, 0, 3)):
        assert (c.vectors_of(codes, last, speculative) == c.vectors_of(codes, last)).all()


def test_extremes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.repair_conversations(empty).count() == 0 and c.repaired_turns(empty).count() == 0
    data = [(1, -(1 << 63), "user", "a.", 1), (1, (1 << 63) - 1, "assistant", "b" * 3_000_000 + ".", 1), (2, 0, "user", "dropped.", 0)]
    frame = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS conv", "2 AS sign", "3 AS known", "4 AS audit")
    rows = {r.conv_id: r for r in c.repair_conversations(frame).collect()}
    assert (rows[1].gaps, rows[1].cost, rows[1].audit) == ((1 << 63) - 1, 0, "KK")
    assert tuple(rows[2]) == (2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    data = [(i if i % 7 else None, t if t % 5 else None, None if t == 3 else "assistant", None if i == 4 else "A. B! C? d", 1) for i in range(40) for t in range(8)]
    frame = spark.createDataFrame(data, SCHEMA)
    assert sorted(map(tuple, c.damaged(frame).collect()), key=repr) == sorted(damage(data), key=repr)
    assert found(c.repair_conversations(c.damaged(frame))) == brute(damage(data))


def test_query_like_sql_and_brute_force(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = found(QUERIES["op11_conversation_repair"](spark, sf_dir))
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert got == brute(damage(rows))
    assert got == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op11_conversation_repair']})").fetchall(), key=repr)
    odd = "(VALUES (1, NULL, 'user', NULL), (1, 0, NULL, 'x.'), (NULL, 5, 'system', 'S.'), (NULL, 9, 'tool', 'T.')) t(conv_id, turn, role, text)"
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM {odd}")
    want = brute(damage(con.sql("SELECT * FROM conversations").fetchall()))
    assert want == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op11_conversation_repair']})").fetchall(), key=repr)
