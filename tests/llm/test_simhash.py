import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pictora.llm import common, simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(prints, distance=2):
    """Class of each print: union of all pairs within the distance."""
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in parent}


def test_fingerprint_is_the_majority_of_the_shingles_hashes():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(rng.choice(["Ab", "é", "c\td", " x", "E!"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute_print(text)
    assert simhash.fingerprint(None) == 0


def test_index_finds_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (40, 30), dtype=np.uint64)) | (np.uint64(1) << rng.integers(0, 64, (40, 30), dtype=np.uint64))
    prints = np.unique(np.r_[base, (base[:, None] ^ flips).ravel()])
    rank = prints.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    prints = prints[np.argsort(rank)]
    found = {(int(i), int(j)) for a, b in simhash.GrayIndex(prints, np.zeros(len(prints), int)).pairs(2) for i, j in zip(a, b)}
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= 2)) if i < j}


@pytest.mark.parametrize("local", [0, 200_000])
def test_links_and_classes_against_all_pairs(spark, monkeypatch, local):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for p in list(prints):
        for _ in range(rng.randrange(8)):  # chains: each step flips at most two more bits
            p ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.append(p)
    want = brute_classes(set(prints))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(p),) for p in set(prints)], "fp long")
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    got = {r.node % 2**64: r.root % 2**64 for r in common.components(simhash.links(frame)).collect()}
    same = lambda c: {frozenset(k for k in c if c[k] == v) for v in set(c.values())}
    assert same(got) == {g for g in same(want) if len(g) > 1}


def test_near_duplicates_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    classes = brute_classes(set(prints.values()))
    least = {}
    for d, p in prints.items():
        least[classes[p]] = min(d, least.get(classes[p], d))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (p, least[classes[p]]) for d, p in prints.items()}
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_odd_rows(spark, odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].component_id == 1 and {by_id[k].fp for k in (3, 4, 6)} == {0} and {by_id[k].component_id for k in (3, 4, 6)} == {3}
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.representatives(nothing).count() == 0


def test_a_large_group_of_copies_keeps_all_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one and the same text").otherwise(F.concat(F.lit("w"), F.hex(F.xxhash64("id")), F.lit(" a "), F.hex(F.xxhash64("id")))).alias("text"))
    got = simhash.near_duplicates(docs)
    assert got.count() == 3000 and got.where("doc_id % 3 = 0").select("component_id").distinct().collect() == [(0,)]
