import random
import re
from collections import Counter

from pictora.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated), len(lines)


def test_measures_against_brute_force():
    rng = random.Random(5)
    for n in [0, 1, 4, 5, 6, 9, 10, 60, 200]:
        for size in (2, 5, 50):
            text = "".join(rng.choice(["a", "é", "#|", "word", " ", "€"][:size]) + rng.choice([" ", " ", "\n", "\t ", "\r\n"]) for _ in range(n))
            assert quality.measure(text.encode()) == brute(text)
    assert quality.measure(None) == (0,) * 6


def test_policies_and_ablations(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality.ledger(docs).cache()
    kept = [r for r in rows.collect() if not r.failed]
    assert rows.where(~quality.fails(quality.DEFAULT)).count() == len(kept)
    names = list(quality.RULES)
    for r in quality.ablations(rows).collect():
        bit = 1 << names.index(r.rule)
        masks = [x.failed for x in rows.collect()]
        assert r.n_failed == sum(bool(m & bit) for m in masks) and r.n_only == sum(m == bit for m in masks) and r.n_kept_without == sum(not m & ~bit for m in masks)


def test_odd_rows(spark, odd, nothing):
    rows = {r.doc_id: r for r in quality.ledger(odd).collect()}
    assert quality.ledger(odd).count() == odd.count() and quality.ledger(nothing).count() == 0
    assert rows[3].n_words == rows[4].n_words == rows[6].n_words == 0 and rows[3].failed == 1
    assert rows[5].n_words == 200_000 and rows[5].n_repeat_words == 200_000
