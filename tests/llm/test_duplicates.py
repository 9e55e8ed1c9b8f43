import random

import numpy as np
import pytest

from tessella.llm import minhash, repeats, suffixes, vectors
from tessella.llm.components import connected_components
from tessella.llm.suffixes import permuted_prefixes, suffix_array


def smallest_reachable(ids, links):
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


def test_components(spark):
    random.seed(1)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    frame = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    want = smallest_reachable({x for e in edges for x in e}, edges)
    got = {r.id: r.component for r in connected_components(frame).collect()}
    assert got == {i: c for i, c in want.items() if i in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert connected_components(frame.limit(0)).count() == 0


def shingle_set(text, k):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def family(seed, n=60):
    """Copies with edits of several strengths, copies, short and odd texts."""
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", " \n", "one", "one", "One two three", "a b c d", "É b c d e", "é b c d e"]
    for _ in range(6):
        base = [random.choice(vocabulary) for _ in range(random.randint(30, 120))]
        for _ in range(n // 6):
            words = list(base)
            for _ in range(random.randint(0, 5)):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, docs_of, k):
    texts = family(k)
    ids = list(range(10, 10 + len(texts)))
    random.shuffle(ids)
    sets = dict(zip(ids, (shingle_set(t, k) for t in texts), strict=True))
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable(ids, links)
    rows = minhash.near_duplicates(docs_of(texts, ids=ids), k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


@pytest.mark.parametrize("rows", [minhash.BUCKET_ROWS, 5])
def test_near_misses_in_crowded_buckets(spark, docs_of, monkeypatch, rows):
    """Texts around one passage, most pairs of which are not near: links that only the last step finds are found."""
    monkeypatch.setattr(minhash, "BUCKET_ROWS", rows)
    random.seed(9)
    base = [f"p{i}" for i in range(90)]
    texts = []
    for i in range(120):
        words = list(base)
        for j in random.sample(range(90), random.choice([1, 2, 3, 5, 8])):
            words[j] = f"e{random.randint(0, 30)}"
        texts.append(" ".join(words))
    sets = {i: shingle_set(t, 5) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(texts)).collect()} == want


@pytest.mark.parametrize("turned", [False, True])
def test_repeated_ids_with_unlike_texts_in_any_order(spark, docs_of, turned):
    random.seed(21)
    made = [[f"{c}{random.randint(0, 900)}" for _ in range(60)] for c in "abcdef"]
    near = lambda w: " ".join([*w[:30], "other", *w[31:]])
    whole = lambda w: " ".join(w)
    # 1 has two unlike texts, 2 and 3 are near one each; 9 joins 7 and 8, which are near its two texts; 5 repeats one text
    rows = [(1, whole(made[0])), (1, whole(made[1])), (2, near(made[0])), (3, near(made[1])), (7, near(made[2])), (8, near(made[3])), (9, whole(made[2])), (9, whole(made[3]))]
    rows += [(5, whole(made[4])), (5, whole(made[4])), (6, near(made[4])), (None, whole(made[0])), (11, whole(made[5])), (11, "")]
    rows = rows[::-1] if turned else rows
    sets = [(i, shingle_set(t, 5)) for i, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    links = [(i, j) for i, x in sets for j, y in sets if None not in (i, j) and i < j and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    want = smallest_reachable(ids, links)
    got = minhash.near_duplicates(docs_of([t for _, t in rows], ids=[i for i, _ in rows]).coalesce(1)).collect()
    assert sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got)) == sorted((i or 0, len(s), want[i] if i else 0) for i, s in sets)
    assert want[3] == 1 and want[8] == want[9] == 7


def test_a_hub_of_many_and_very_long_texts(spark, docs_of, monkeypatch):
    """A hub that is dealt among copies, and texts whose shingles take many strides."""
    monkeypatch.setattr(minhash, "HOT_ROWS", 4)
    random.seed(11)
    base = [f"p{i}" for i in range(100)]
    long = [f"v{random.randint(0, 50_000)}" for _ in range(120_000)]
    texts = [" ".join(long), " ".join(long[:110_000] + ["new"] * 3)]
    for i in range(40):
        words = list(base)
        words[i * 2] = f"e{i}"
        texts.append(" ".join(words))
    sets = {i: shingle_set(t, 5) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    rows = minhash.near_duplicates(docs_of(texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == smallest_reachable(sets, links) and (0, 1) in links
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in sets.items()}


def test_parities_never_differ_in_more_cells_than_sets():
    random = np.random.default_rng(4)
    for _ in range(200):
        whole = random.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = whole[random.random(400) < 0.9], whole[random.random(400) < 0.8]
        apart = len(np.setxor1d(a, b))
        assert int(np.bitwise_count(minhash._sketch(a) ^ minhash._sketch(b)).sum()) <= apart


def test_one_document_of_each_group_stays(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(50))
    docs = docs_of([long, long + " x", None, "", "other", "other2", long], ids=[3, 1, 4, 5, 6, 6, None])
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert minhash.keep_one_of_each(docs_of([])).count() == 0


def test_strides_change_nothing(monkeypatch):
    """Anchors, runs and words of long texts are those of the whole, whatever the stride."""
    random = np.random.default_rng(6)
    for n in (30, 31, 64, 700):
        raw = random.integers(97, 100, n).astype(np.uint8)
        whole = repeats.pieces_of(raw, 10, 20)
        for stride in (1, 7, 23):
            monkeypatch.setattr(repeats, "STRIDE", stride)
            assert all((a == b).all() for a, b in zip(whole, repeats.pieces_of(raw, 10, 20), strict=True))
        monkeypatch.setattr(repeats, "STRIDE", 1 << 20)
    from tessella.llm import shingles

    for _ in range(30):
        texts = ["".join(random.choice(list("ab \n")) for _ in range(random.integers(0, 60))).encode() for _ in range(6)]
        raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        whole = shingles.word_hashes(raw, offsets)
        for stride in (1, 5, 17):
            monkeypatch.setattr(shingles, "STRIDE", stride)
            assert all((a == b).all() for a, b in zip(whole, shingles.word_hashes(raw, offsets), strict=True))
        monkeypatch.setattr(shingles, "STRIDE", 1 << 20)


@pytest.mark.parametrize("most", [1024, 3, 2])
def test_suffix_arrays_equal_sorting(monkeypatch, most):
    """Down to small alphabets, where names are written as digits and sorted again, level by level."""
    monkeypatch.setattr(suffixes, "LETTERS", most)
    random.seed(3)
    for _ in range(300):
        n, letters = random.randint(0, 70), random.choice([1, 2, 3, 6, 40])
        text = [random.randint(0, letters - 1) for _ in range(n)]
        if random.random() < 0.3:
            text = text[: random.randint(1, 9)] * 7
        order = suffix_array(np.array(text, np.int64))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lengths = permuted_prefixes(np.array(text, np.int64), order)
        for a, b in zip(order[1:], order[:-1], strict=True):
            k = 0
            while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert lengths[a] == k


def brute_repeats(texts, match):
    raws = [(t or "").encode() for t in texts]
    count = {}
    for raw in raws:
        for i in range(len(raw) - match + 1):
            count[raw[i : i + match]] = count.get(raw[i : i + match], 0) + 1
    out = []
    for raw in raws:
        gone = [False] * len(raw)
        for i in range(len(raw) - match + 1):
            if count[raw[i : i + match]] > 1:
                gone[i : i + match] = [True] * match
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), runs, bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("limits", [(1 << 20, 4 << 20), (3000, 400)])
def test_repeats_equal_brute_force(spark, docs_of, limits):
    random.seed(4)
    word = lambda n: "".join(random.choice("abcdeé ") for _ in range(n))
    passage, line = word(300), word(37)
    texts = [None, "", "short", "z" * 200, word(50) + line * 8 + word(30), line * 3]
    for i in range(40):
        cut = random.randint(0, 200)
        texts.append(word(random.randint(0, 150)) + passage[cut : cut + random.randint(20, 300)] + word(random.randint(0, 150)))
    texts += [texts[10], texts[10], texts[11][:90], word(60) + passage]
    docs = docs_of(texts)
    rows = repeats.remove_repeats(docs, 80, *limits).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    assert len(rows) == len(texts) and got == dict(enumerate(brute_repeats(texts, 80)))


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_anchors_keep_real_places(spark, docs_of, seed):
    """Passages at other offsets in near copies, split several times: nothing else goes."""
    random.seed(seed)
    word = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    core, texts = word(80), []
    for _ in range(8):
        passage = word(60) + core + word(60)
        texts += [word(random.randint(0, 600)) + passage + word(random.randint(0, 600)) for _ in range(2)]
    rows = repeats.remove_repeats(docs_of(texts), 80, 3000, 400).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    assert got == dict(enumerate(brute_repeats(texts, 80)))


def test_repeats_in_very_long_texts_and_a_hot_passage(spark, docs_of, monkeypatch):
    """Texts far longer than a slice, runs of one letter, and a passage in so many documents that its anchor is hot."""
    from tessella.llm import picking

    monkeypatch.setattr(picking, "HOT_ROWS", 5)
    random.seed(6)
    word = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = word(500)
    long = word(3_000_000)
    texts = [long, "q" * 50_000, word(30) + passage + word(40) + "q" * 700, long[1_000_000:1_000_900]]
    texts += [word(random.randint(0, 90)) + passage + word(random.randint(0, 90)) for _ in range(30)]
    rows = {r.doc_id: r for r in repeats.remove_repeats(docs_of(texts)).collect()}
    assert (rows[0].n_removed, rows[0].n_spans) == (900, 1) and bytes(rows[0].kept) == (long[:1_000_000] + long[1_000_900:]).encode()
    assert rows[1].n_removed == 50_000 and rows[3].n_removed == 900
    assert rows[2].n_removed >= 1200 and rows[2].n_spans == 2
    want = brute_repeats(texts[4:], 400)
    assert [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, bytes(rows[i].kept)) for i in range(4, 34)] == want


def test_repeats_of_nothing_and_of_repeated_rows(spark, docs_of):
    assert repeats.remove_repeats(docs_of([]), 80).count() == 0
    rows = repeats.remove_repeats(docs_of(["q" * 10 + "abc" * 40, "unlike " * 3, "q" * 10 + "abc" * 40], ids=[1, 1, None]), 80).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(21, 0), (130, 130), (130, 130)]


def brute_links(rows):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.linalg.norm(v)}
    out = {i: set() for i, _ in rows}
    for a, x in good.items():
        for b, y in good.items():
            if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                out[a].add(b)
                out[b].add(a)
    return out


def check_vectors(spark, rows):
    links = brute_links(rows)
    want = smallest_reachable(links, [(a, b) for a in links for b in links[a]])
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect()}
    assert got == {i: (len(links[i]), want[i], want[i] == i) for i in links}


def near_rows(n, groups, dimension=16, seed=1):
    random = np.random.default_rng(seed)
    rows = list(random.normal(size=(n, dimension)))
    for size in groups:
        centre = random.normal(size=dimension)
        rows += [centre + random.normal(size=dimension) * 0.12 for _ in range(size)]
    return [(i, v.tolist()) for i, v in enumerate(rows)]


def test_vectors_equal_brute_force(spark):
    rows = near_rows(60, [2, 5, 30])
    top = len(rows)
    rows += [(top, None), (top + 1, [0.0] * 16), (top + 2, [float("nan")] * 16), (top + 3, rows[0][1]), (top + 4, [2 * x for x in rows[1][1]]), (top + 5, [1.0, 0.0]), (top + 6, [1.0, 0.1]), (top + 7, []), (top + 8, [None, 1.0])]
    check_vectors(spark, rows)


def recall_of(spark, rows):
    links = brute_links(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(frame).collect()}
    assert len(got) == len(rows) and all(got[i] <= len(links[i]) for i in links)
    return sum(got.values()), sum(map(len, links.values()))


def test_forest_with_spill_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 40)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    found, total = recall_of(spark, near_rows(400, [150, 20, 3], seed=4))
    assert found >= 0.97 * total


def linked_rows(n, seed):
    """Pairs and small groups of 64 dimensions with cosines around 0.95."""
    random = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        centre = random.normal(size=64)
        rows += [centre + random.normal(size=64) * random.uniform(0.1, 0.17) for _ in range(random.integers(1, 5))]
    return rows


@pytest.mark.parametrize("tight", [0, 300])
def test_leaves_are_split_until_they_are_small(spark, monkeypatch, tight):
    """A small sample fits few levels, so that most splits are made leaf by leaf; a tight group cannot be split."""
    for name, value in (("LEAF", 40), ("BLOCK", 64), ("MOST", 120), ("SPLIT_SAMPLE", 100)):
        monkeypatch.setattr(vectors, name, value)
    random = np.random.default_rng(3)
    centre = random.normal(size=64)
    rows = linked_rows(2500, 5) + [centre + random.normal(size=64) * 0.01 for _ in range(tight)]
    links = {i: 0 for i in range(len(rows))}
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_vectors(frame, sample=64).collect()}
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum() and links[:2500].sum() > 1000
    if tight:
        assert (found[-tight:] >= tight - 1).all() and len({got[i].component_id for i in range(len(rows) - tight, len(rows))}) == 1


def test_a_split_leaf_is_bounded():
    random = np.random.default_rng(1)
    unit = random.normal(size=(4000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tree = vectors.fit_tree(unit, 4, 1)
    _, leaves = tree.leaves(unit)
    assert np.bincount(leaves).max() < 800
    same = np.repeat(unit[:1], 50, axis=0) + random.normal(size=(50, 64)) * 1e-4
    rows, _ = vectors.fit_tree(same, 4, 1).leaves(same)
    assert len(rows) == 50  # no split, no copies


def test_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectors.near_vectors(empty).count() == 0
    rows = vectors.near_vectors(spark.createDataFrame([(None, [1.0]), (1, None)], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in rows if r.vec_id) == [(1, 0, 1, True)] and len(rows) == 2
