"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log holds events ``(conv_id, seq, turn, kind, role, text)``. Of each turn the events are put in the order of ``seq`` and
folded: ``message`` opens a message, ``delta`` appends to the open one, ``edit`` replaces what it says so far, and
``regenerate`` empties it and lets later deltas say it anew. The final messages are then rendered, turn by turn:

    ### assistant: the text</turn>\\n

Control characters inside roles and texts are written as two characters that occur nowhere in a marker (backslash, less
than, number sign; in roles the colon as well), so the text between two markers can hold anything and reads back exactly.

The folding and the rendering are dealt out by conversation and turn, so that only finished pieces meet in the one
row that a conversation is; a very long conversation costs one long row but no long sort or fold in one task.

Defined cases: null text or role is empty; deltas before any message open one, edits likewise, and a message that follows is another
one; an event of an unknown or null kind adds its text as a delta does; of events with one ``seq`` the order is by kind (message, edit, regenerate, delta), role, text; two messages in one turn are both kept, in that order; a
null turn comes first; null conv_ids are one conversation; an empty log gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, END = "### ", "</turn>\n"
#: What stands for each control character. The backslash comes first when escaping and last when reading back.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
LEARNED = "assistant"
KINDS = ("message", "edit", "regenerate", "delta")


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(role: Column, text: Column) -> Column:
    """One rendered turn."""
    return F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(": "), escape(text), F.lit(END))


def messages(events: DataFrame) -> DataFrame:
    """The final messages ``(conv_id, turn, part, role, text)``; part numbers the messages of one turn."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0).cast("long")), F.lit(len(KINDS)).cast("long"))
    log = events.select("conv_id", "turn", "seq", rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "rank", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    log = log.select("*", F.row_number().over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("step"), (F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).over(order) + F.when(F.first("rank").over(order) == 1, 0).otherwise(1)).alias("part"), F.sum(F.when(F.col("rank") <= 3, 1).otherwise(0)).over(order).alias("reset"))
    # Of a message only what follows its last reset counts; the role is the one its first event names.
    last = Window.partitionBy("conv_id", "turn", "part")
    log = log.withColumn("last_reset", F.max("reset").over(last))
    said = F.when(F.col("reset") == F.col("last_reset"), F.struct("step", F.when(F.col("rank") == 3, "").otherwise(F.col("text")).alias("text")))
    folded = log.groupBy("conv_id", "turn", "part").agg(F.min(F.struct(F.when(F.col("role") != "", 0).otherwise(1), "step", "role"))["role"].alias("role"), F.sort_array(F.collect_list(said)).alias("said"))
    return folded.select("conv_id", "turn", "part", "role", F.array_join(F.col("said.text"), "").alias("text"))


def conversations(final: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_spans)``: the rendered text, and the spans a loss is taken on.

    A span names its turn in the rendered text and, in code points from the beginning of that turn, where it starts and how long it is.
    """
    text = escape(F.col("text"))
    head = F.lit(len(OPEN)) + F.length(escape(F.col("role"), ROLE_ESCAPES)) + 2
    piece = final.select("conv_id", "turn", "part", render(F.col("role"), F.col("text")).alias("piece"), F.when(F.col("role") == LEARNED, F.struct(head.alias("start"), F.length(text).alias("length"))).alias("span"))
    whole = piece.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "part", "piece", "span"))).alias("pieces"))
    spans = F.transform("pieces", lambda x, i: F.when(x["span"].isNotNull(), F.struct(i.alias("turn"), x["span"]["start"].alias("start"), x["span"]["length"].alias("length"))))
    return whole.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From ``conversations``: ``(conv_id, turns, loss_texts, formatted)``, turns an array of (role, text), loss_texts what the spans cover, unescaped."""
    raw = F.split("formatted", END)
    raw = F.slice(raw, 1, F.size(raw) - 1)
    body = lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.length(x))
    name = lambda x: F.substring_index(x, ": ", 1)
    turn = lambda x: F.struct(unescape(name(x), ROLE_ESCAPES).alias("role"), unescape(F.substring(x, F.length(name(x)) + 3, F.length(x))).alias("text"))
    read = formatted.select("conv_id", "formatted", "loss_spans", raw.alias("raw"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.get("raw", s["turn"]), s["start"] + 1, s["length"])))
    return read.select("conv_id", F.transform("raw", lambda x: turn(body(x))).alias("turns"), loss.alias("loss_texts"), "formatted")


def digests(read: DataFrame) -> DataFrame:
    """One row of digests for each conversation read back."""
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
