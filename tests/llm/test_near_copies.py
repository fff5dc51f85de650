import random

import numpy as np

from pictora.llm import near_copies


def brute_near(texts, similarity=0.8):
    """Smallest id of each text's class: texts joined by links of that similarity on five-word shingles."""
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    sets, parent = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if a < b and small >= similarity * large and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in texts}


def test_near_copies_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_near({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    assert {r.doc_id for r in near_copies.representatives(docs, near_copies.near_copies(docs)).collect()} == set(want.values())


def test_near_copies_of_edited_texts(spark):
    """Texts with a few words changed join their original; those with many changed, and others, stay apart."""
    rng = random.Random(5)
    texts, light, heavy = {}, {}, {}
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts[10 * k] = " ".join(words)
        for n, group, number in ((1, light, 1), (3, light, 2), (12, heavy, 3)):
            other = list(words)
            for at in rng.sample(range(150), n):
                other[at] = "changed" + str(rng.randrange(10**6))
            texts[10 * k + number] = " ".join(other)
            group[10 * k + number] = 10 * k
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got, want = {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()}, brute_near(texts)
    assert all(got[d] >= want[d] for d in got) and all(want[d] == d for d in heavy)
    assert all(got[d] == of for d, of in light.items() if d % 10 == 1)  # a similarity of 0.94 or more
    assert sum(got[d] == of for d, of in light.items() if d % 10 == 2) == 60  # of 0.81 or more
    assert all(got[d] == d for d in heavy)


def test_near_copies_of_odd_rows(spark, odd, nothing):
    rows = near_copies.near_copies(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 1), (3, 3), (4, 3), (6, 3), (None, 1), (5, 5), (7, 7), (8, 8)}
    assert near_copies.near_copies(nothing).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    """Thousands of near copies are one class."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base, f"x{k}", f"y{k % 50}"])) for k in range(6000)]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got.count() == 6000 and {r.component_id for r in got.select("component_id").distinct().collect()} == {0}


def substituted(rng, words, n):
    """The words with n of their every fifth ones replaced, so that each costs five shingles."""
    other = list(words)
    for at in rng.sample(range(4, len(words) - 4, 5), n):
        other[at] = f"x{rng.getrandbits(60)}"
    return other


def test_near_copies_in_a_large_family_of_alike_texts(spark):
    """A template's texts, 0.7 to 0.8 alike, do not hide the pairs among them that are 0.86 alike."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(354)]
    texts = {2 * k: substituted(rng, base, 6) for k in range(2000)}
    pairs = {2 * k + 1: substituted(rng, texts[2 * k], 5) for k in range(100)}
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in {**texts, **pairs}.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()}
    assert sum(got[d] == got[d - 1] for d in pairs) == len(pairs)
    assert len(set(got.values())) > 1500


def test_near_copies_at_the_least_similarity_are_all_found(spark):
    """Pairs at 0.80 to 0.83, long and short: none is lost."""
    rng = random.Random(7)
    texts = {}
    for k in range(200):
        n = (104, 154, 304, 1004)[k % 4]
        texts[2 * k] = [f"w{rng.getrandbits(60)}" for _ in range(n)]
        texts[2 * k + 1] = substituted(rng, texts[2 * k], (n - 4) // 9 // 5)
    texts = {d: " ".join(w) for d, w in texts.items()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()}
    assert got == brute_near(texts) and all(got[2 * k + 1] == 2 * k for k in range(200))


def test_rows_with_null_or_repeated_ids_are_judged_by_their_own_text(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.getrandbits(40)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (None, a + " more"), (None, b), (2, c), (2, d), (3, d), (3, d)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.representatives(frame, near_copies.near_copies(frame))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, a), (0, b), (2, c), (2, d)])


def test_recall_in_a_skewed_group(spark):
    """Edits of one text, at all similarities to one another: the classes are those of all pairs."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    texts = {0: " ".join(base)}
    for k in range(1, 500):
        other = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 14)):
            other[at] = f"x{rng.getrandbits(50)}"
        texts[k] = " ".join(other)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()}
    assert got == brute_near(texts) and 1 < len(set(got.values())) < 400


def test_cells_hold_each_pair_of_two_classes(spark, monkeypatch):
    """With cells of eight texts, each pair of different classes meets, and none of one class."""
    from pictora.llm.common import Tables

    monkeypatch.setattr(near_copies, "SQUARE", 8)
    rooted = spark.createDataFrame([(k, 0 if k < 40 else k) for k in range(60)], "node long, root long")
    met = spark.createDataFrame([(7, k, 0) for k in range(60)] + [(8, k, 0) for k in range(3)] + [(9, 1, 0), (9, 50, 0)], "shingle long, node long, place int")
    cells = {}
    for r in near_copies._cells(met, rooted, Tables(spark)).collect():
        cells.setdefault((r.shingle, r.a, r.b), ([], []))[min(r.side, 1)].append(r.node)
    root = lambda k: 0 if k < 40 else k
    made = {(s, min(x, y), max(x, y)) for (s, _, _), (left, right) in cells.items() for x in left for y in right if root(x) != root(y)}
    assert made == {(7, x, y) for y in range(40, 60) for x in range(y)} | {(9, 1, 50)}
    assert max(len(left) for left, _ in cells.values()) < 20


def test_sketches_of_different_widths_are_compared_at_the_narrower():
    rng = np.random.default_rng(4)
    narrow, wide = rng.integers(0, 1 << 62, (2, 8)).astype(np.uint64), rng.integers(0, 1 << 62, (2, 16)).astype(np.uint64)
    got = near_copies.Sketches([x.tobytes() for x in (*narrow, *wide)]).apart(np.array([0, 0, 2, 1]), np.array([1, 2, 3, 3]))
    want = [narrow[0] ^ narrow[1], narrow[0] ^ wide[0][:8] ^ wide[0][8:], wide[0] ^ wide[1], narrow[1] ^ wide[1][:8] ^ wide[1][8:]]
    assert got.tolist() == [int(np.bitwise_count(x).sum()) for x in want]


def test_prefixes_of_long_texts_are_whole(spark, monkeypatch):
    """No shingle of a prefix is left to chance, and any order of the shingles, so any sample, gives the same classes."""
    rng = np.random.default_rng(10)
    none = np.empty(0, np.uint64)
    for n in (10, 600, 5000):
        shingles = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        found, places = near_copies.prefix(shingles, none, np.empty(0, np.int64), 0.8)
        assert found.tolist() == shingles[: n - -(-4 * n // 5) + 1].tolist() and places.tolist() == list(range(len(found)))
    draw = random.Random(11)
    texts = {}
    for k in range(12):
        n = (104, 1004, 3004)[k % 3]
        texts[2 * k] = [f"w{draw.getrandbits(60)}" for _ in range(n)]
        texts[2 * k + 1] = substituted(draw, texts[2 * k], (n - 4) // 9 // 5)
    texts = {d: " ".join(w) for d, w in texts.items()}
    every = np.unique(np.concatenate([near_copies.shingle_hashes(t.encode())[1] for t in texts.values()]))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    weight = rng.integers(0, 50, len(every))
    monkeypatch.setattr(near_copies, "_common", lambda source: (every, weight))
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()} == {d: d - d % 2 for d in texts}
