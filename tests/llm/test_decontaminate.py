import random
from itertools import combinations

from pictora.llm import decontaminate


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_any_two_of_fourteen_words_may_be_substituted():
    for gone in combinations(range(14), 2):
        hit = any(all(at + k not in gone for k, b in enumerate(m) if b == "1") for m in decontaminate.MASKS for at in range(14 - len(m) + 1))
        assert hit, gone


def test_leaks_with_substitutions_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(6)
    items = [words(rng, n) for n in (14, 20, 40, 60, 3, 5, 1)]
    docs, want = [], set()
    for i, item in enumerate(items):
        for subs in (0, 1, 2):
            leak = list(item)
            if len(item) < 10 and subs:
                continue
            for k in rng.sample(range(len(item)), subs):
                leak[k] = "other"
            docs.append((len(docs), " ".join([*words(rng, 30), *leak, *words(rng, 5)]).upper() + "."))
            want.add((len(docs) - 1, i))
    docs += [(len(docs) + k, " ".join(words(rng, 80))) for k in range(5)]
    docs.append((99, " ".join(items[3][10:24])))  # fourteen words of sixty in a row
    want.add((99, 3))
    docs.append((98, " ".join(items[3][10:20])))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_blocks_of_items_give_the_same(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(decontaminate.overlaps(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 700)
    assert sorted(decontaminate.overlaps(docs, items).collect()) == whole and whole


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "seven wizards box quietly near the old stone bridge"), (1, "seven wizards box quietly near the old stone bridge"), (2, None), (3, ""), (None, "zwei"), (4, "alpha beta gamma delta alpha beta gamma delta")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in decontaminate.overlaps(odd, items).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (5, 4), (7, 0)]
    assert decontaminate.overlaps(nothing, items).count() == 0
    assert decontaminate.overlaps(odd, items.where("false")).count() == 0


def test_items_with_all_substitutions_that_the_rule_allows(spark):
    """Five to twenty words, a fifth of them substituted at random places: every item is found up to thirteen words, and practically all beyond."""
    rng = random.Random(11)
    items, docs = [], []
    for n in range(5, 21):
        for k in range(30):
            words = [f"w{rng.getrandbits(40)}" for _ in range(n)]
            items.append((100 * n + k, " ".join(words)))
            for at in rng.sample(range(n), n // 5):
                words[at] = f"x{rng.getrandbits(40)}"
            around = [f"y{rng.getrandbits(40)}" for _ in range(30)]
            docs.append((100 * n + k, " ".join([*around[:15], *words, *around[15:]])))
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    missed = {d for d, _ in docs} - {d for d, i in found if d == i}
    assert len(found) == len(docs) - len(missed) and not {d for d in missed if d < 1400} and len(missed) <= 4
    only_mid = decontaminate.overlaps(spark.createDataFrame(docs[:30], "doc_id long, text string"), spark.createDataFrame(items[:30], "item_id long, text string"))
    assert only_mid.count() == 30
