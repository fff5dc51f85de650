import random

import numpy as np

from pyspark.sql import functions as F

from pictora.llm import licenses


def test_every_template_is_found_whole_and_with_an_edit(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join("".join(rng.choice("qxzvk") for _ in range(7)) for _ in range(n))
    docs, want = [], {}
    for name, text in licenses.TEMPLATES.items():
        docs.append((len(docs), f"{noise(40)}\n{text}\n{noise(10)}"))
        want[len(docs) - 1] = (name, 1.0, 40, 40 + len(licenses.words_of(text.encode())))
        if len(words := text.split()) > 12:
            words[6:8] = ["changed"]
            docs.append((len(docs), f"{noise(5)} {' '.join(words)}"))
            want[len(docs) - 1] = (name, None, None, None)
    docs += [(1000, noise(500)), (1001, "the license of the work is the version of the license")]
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.license): r for r in rows}
    for d, (name, coverage, start, end) in want.items():
        r = found[d, name]
        assert coverage is None and r.coverage >= 0.8 or (r.coverage, r.agreement, r.start_word, r.end_word) == (1.0, 1.0, start, end)
    assert not {1000, 1001} & {r.doc_id for r in rows}


def test_alignment_of_edited_templates():
    """Two words left out and one put in: the coverage is that of the words that are left, and the span lies within three words of the true one."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        t = rng.integers(0, 50, 30)
        text = np.delete(t, rng.integers(0, 30, 2))
        text = np.insert(text, 10, 99)
        text = np.r_[rng.integers(100, 200, 20), text, rng.integers(100, 200, 20)]
        coverage, _, start, end = licenses.align(t, text, 20)
        assert coverage >= 26 / 30 and 17 <= start <= 23 and 46 <= end <= 52


def test_winnowing_keeps_one_in_each_window():
    rng = random.Random(10)
    for _ in range(50):
        h = [rng.randrange(8) for _ in range(rng.randrange(1, 20))]
        kept = licenses.winnow(h, 4)
        assert all(set(kept) & set(range(i, i + 4)) for i in range(max(1, len(h) - 3)))


def test_odd_rows(spark, odd, nothing):
    assert licenses.scan(odd).count() == 0 and licenses.scan(nothing).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License. " + "x " * 40 + "Released under the MIT License."), (1, "Released under the MIT License.")], "doc_id long, text string")
    assert [r.start_word for r in licenses.scan(twice).orderBy("start_word").collect()] == [0, 0, 45]


def test_notices_that_adjoin_are_all_reported(spark):
    """Runs of one to four notices, each whole or with one word changed or left out, between other words: each is a match of its own."""
    rng = random.Random(12)
    rows, want = [], {}
    for d in range(120):
        name = rng.choice(["MIT", "CC-BY-NC-4.0", "GPL-3.0", "Unlicense"])
        words, n = [f"q{rng.getrandbits(30)}" for _ in range(rng.randrange(20))], rng.randrange(1, 5)
        spans = []
        for _ in range(n):
            notice = [w.decode() for w in licenses.words_of(licenses.TEMPLATES[name].encode())]
            if len(notice) >= 10:
                edit, at = rng.randrange(3), rng.choice([0, len(notice) - 1])
                notice = notice if edit == 0 else notice[:at] + (["changed"] if edit == 1 else []) + notice[at + 1 :]
            spans.append((len(words), len(words) + len(notice)))
            words += notice
        rows.append((d, " ".join([*words, *(f"z{rng.getrandbits(30)}" for _ in range(10))])))
        want[d] = (name, spans)
    found = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault((r.doc_id, r.license), []).append((r.start_word, r.end_word))
    for d, (name, spans) in want.items():
        got = sorted(found[d, name])
        assert len(got) == len(spans), (d, name, got, spans)
        assert all(abs(a - x) <= 1 and abs(b - y) <= 1 for (a, b), (x, y) in zip(got, spans)), (d, name, got, spans)


def test_a_long_text_with_matches_and_templates_that_tie(spark):
    long = "filler words go here " * 20_000 + "Released under the MIT License. " + "and more words " * 20_000
    rows = spark.createDataFrame([(1, long)], "doc_id long, text string").withColumn("license", F.lit("x")).withColumn("coverage", F.lit("x"))
    assert [(r.license, r.start_word, r.end_word) for r in licenses.scan(rows).collect()] == [("MIT", 80_000, 80_005)]
    twins = {"a": "Released under the MIT License.", "b": "Released under the MIT License."}
    assert sorted(r.license for r in licenses.scan(rows, twins).collect()) == ["a", "b"]
