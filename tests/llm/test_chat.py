from pyspark.sql import functions as F

from pictora.llm import chat, queries

SCHEMA = "conv_id long, seq long, turn long, kind string, role string, text string"


def formatted(spark, events):
    return chat.conversations(chat.messages(spark.createDataFrame(events, SCHEMA)))


def read(spark, events):
    return {r.conv_id: ([tuple(t) for t in r.turns], r.loss_texts) for r in chat.read_back(formatted(spark, events)).collect()}


def test_deltas_edits_and_regenerations_fold(spark):
    events = [
        (1, 1, 0, "message", "user", "helo"), (1, 2, 0, "edit", None, "hello"), (1, 3, 1, "message", "assistant", ""), (1, 4, 1, "delta", None, "wr"),
        (1, 5, 1, "delta", None, "ong"), (1, 6, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "ri"), (1, 8, 1, "delta", None, "ght"), (1, 9, 0, "delta", None, "!"),
        (2, 1, 0, "delta", "user", "no opening"),
    ]
    import random

    random.Random(4).shuffle(events)
    got = read(spark, events)
    assert got[1] == ([("user", "hello!"), ("assistant", "right")], ["right"])
    assert got[2] == ([("user", "no opening")], [])


def test_anything_reads_back(spark):
    nasty = [queries.CONTROL, "\\", "\\b", "\\\\l<#", "</turn>\n### user: x", "### assistant: ", "", "é\n\n#", ": ", "\\h\\l\\b\\c"]
    events = [(1, i, i, "message", "assistant" if i % 2 else "us:er\\", t) for i, t in enumerate(nasty)]
    turns, loss = read(spark, events)[1]
    assert turns == [(e[4], e[5]) for e in events] and loss == [t for i, t in enumerate(nasty) if i % 2]


def test_loss_spans_cover_the_assistants_text_only(spark):
    row = formatted(spark, [(1, 0, 0, "message", "user", "a<b"), (1, 1, 1, "message", "assistant", "c#d")]).first()
    pieces = [p + chat.END for p in row.formatted.split(chat.END)[:-1]]
    assert [pieces[s.turn][s.start : s.start + s.length] for s in row.loss_spans] == ["c\\hd"]


def test_odd_rows(spark):
    events = [
        (None, 0, None, "message", None, None), (None, 1, 3, "message", "user", "x"), (5, 0, 0, "message", "user", "same"), (5, 0, 0, "message", "user", "same"),
        (6, None, 0, "unknown", "user", "y"), (7, 0, 0, "message", "assistant", "long " * 200_000),
    ]
    got = read(spark, events)
    assert got[None][0] == [("", ""), ("user", "x")]
    assert got[5][0] == [("user", "same")] * 2
    assert got[7][1] == ["long " * 200_000]
    assert formatted(spark, []).count() == 0


def test_query_against_python(spark, sf_dir):
    import hashlib
    from collections import defaultdict

    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", queries.CONTROL), (1, "assistant", queries.CONTROL)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in queries.op1_chat_formatting(spark, sf_dir).collect()}
    assert set(got) == set(turns)
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_no_event_replaces_or_loses_what_others_say(spark):
    """Unknown and null kinds add their text; what is said before a turn's first message is a message of its own; clashing names are ignored."""
    rows = [
        (1, 0, 0, "message", "user", "hello"), (1, 1, 0, "tool", None, " X"), (1, 2, 0, None, None, " Y"),
        (2, 0, 0, "delta", "assistant", "lost?"), (2, 1, 0, "message", "user", "kept"), (2, 2, 0, "delta", None, "!"),
        (3, 0, 0, "edit", "user", "first"), (3, 1, 0, "edit", None, "second"),
        (4, 0, 0, "tool", "tool", "only"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")
    for name in ("rank", "part", "reset", "step", "last_reset", "said", "piece", "span", "raw"):
        events = events.withColumn(name, F.lit("x"))
    found = {}
    for r in chat.messages(events).orderBy("conv_id", "turn", "part").collect():
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    assert found == {1: [("user", "hello X Y")], 2: [("assistant", "lost?"), ("user", "kept!")], 3: [("user", "second")], 4: [("tool", "only")]}
