import hashlib
from collections import defaultdict

import pytest

from pictora.llm import mixing


def test_shortages_go_to_siblings_first():
    leaves = {("a", "en", "x"): 10, ("a", "en", "y"): 100, ("a", "de", "z"): 100, ("b", "en", "x"): 1000}
    got = mixing.budgets(leaves, 160)
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 30, ("a", "de", "z"): 40, ("b", "en", "x"): 80}
    # What en cannot take goes to de; what a cannot take goes to b.
    assert mixing.budgets(leaves, 300) == {("a", "en", "x"): 10, ("a", "en", "y"): 65, ("a", "de", "z"): 75, ("b", "en", "x"): 150}
    assert mixing.budgets(leaves, 600) == {("a", "en", "x"): 10, ("a", "en", "y"): 100, ("a", "de", "z"): 100, ("b", "en", "x"): 390}
    assert mixing.budgets(leaves, 10**6) == leaves
    assert mixing.budgets(leaves, 160, {("a",): 3.0, ("a", "de"): 0.0})[("b", "en", "x")] == 50


@pytest.mark.parametrize("share,epochs,bucket", [(0.8, 4, 20_000), (0.5, 1, 5), (1.7, 3, 7)])
def test_selection_is_the_prefix_of_seeded_epochs(spark, sf_dir, monkeypatch, share, epochs, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.select(docs, share=share, max_epochs=epochs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    leaves = defaultdict(list)
    for r in rows:
        leaves[r.domain, r.lang, r.source].append(r)
    total = {p: sum(r.n_tokens for r in x) for p, x in leaves.items()}
    given = mixing.budgets({p: t * epochs for p, t in total.items()}, share * sum(total.values()))
    for path, x in leaves.items():
        whole, rest = divmod(int(given[path] + 1e-6), total[path])
        place = {r.doc_id: int(hashlib.md5(f"{r.doc_id}/17/{whole}".encode()).hexdigest()[:15], 16) for r in x}
        taken, left = {}, rest
        for r in sorted(x, key=lambda r: (place[r.doc_id], r.doc_id)):
            taken[r.doc_id] = whole + (left >= r.n_tokens)
            left = left - r.n_tokens if left >= r.n_tokens else -1
        assert {r.doc_id: r.epochs for r in x} == taken


def test_odd_rows(spark, odd, nothing):
    rows = mixing.select(odd, share=5.0)
    assert rows.count() == odd.count() and mixing.select(nothing).count() == 0
    got = {r.doc_id: r for r in rows.collect()}
    assert got[3].n_tokens == got[4].n_tokens == 0 and got[4].source is None
