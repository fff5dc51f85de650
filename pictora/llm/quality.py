"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once for each document and stores the measurements and one bit per failed rule. A policy
is a named, versioned set of rule bits: applying another version, or asking what each rule alone changes, is bitwise
arithmetic on the stored masks and never reads a text again.

Defined cases: a null text measures as an empty one; texts of any length are measured whole; repeated rows are measured
each; an empty table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SYMBOLS = b"[#*$%&|<>]"[1:-1]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Each rule's condition of failure over the measurements; its place is its bit. Rules are appended, never moved.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines > 0 and 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version of the filter: a document fails if any of ``rules`` failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
DEFAULT = Policy("default", 1, tuple(RULES))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of five words found twice or more in the text, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seen = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed = (hashed ^ seen[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    # Equal windows have equal hashes: only windows whose hash occurs twice are compared word by word.
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    if not same.any():
        return 0
    maybe = np.sort(order[np.r_[same, False] | np.r_[False, same]]).tolist()
    keys = seen.tolist()
    count = Counter(windows := [tuple(keys[i : i + window]) for i in maybe])
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, w in zip(maybe, windows) if count[w] > 1], np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The ``MEASURES`` of one UTF-8 text."""
    text = text or b""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([measure(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """``(doc_id, measurements..., failed)`` for each row of ``docs(doc_id, text)``; bit k of ``failed``: rule k failed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(_measures, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return rows.withColumn("failed", failed.cast("long"))


def fails(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) != 0


def ablations(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of a policy: documents it fails, those it alone fails, and those kept without it.

    Masks are counted first, so what is exploded has at most 2**len(RULES) rows.
    """
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("mask")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    each = masks.select("mask", "n", rules).select("mask", "n", "r.rule", "r.bit")
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    rest = F.col("mask").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
