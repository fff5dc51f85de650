"""Language identification as a mixture: expectation-maximisation of each document's language proportions.

A model holds, for each language, the smoothed likelihood of hashed letter trigrams, fitted on at most
``ROWS_PER_LANGUAGE`` labelled rows of each language (the rows with the smallest hash of their id). For a document the
proportions of a set of languages are estimated by EM over its trigram counts. Languages join the set one by one, in
the order of their share of the document's trigrams, as long as the likelihood rises by more than the penalty (a
multiple of the Bayesian criterion's log n); the prediction is the language with the largest proportion, its score that
proportion.

Defined cases: text that is null or has no letter is ``und`` with score 0; so is every text where no labelled row exists;
rows with null labels are not learned from; repeated rows are predicted each; texts of any length are used whole;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pictora.llm.common import durable, lean, small

BITS = 18
#: Labelled rows of each language that a model is fitted on, at most.
ROWS_PER_LANGUAGE = 400
PENALTY = 3.0
SMOOTHING = 0.5
ROUNDS = 6
#: Characters that are scored together; a longer text is scored alone.
CHARS = 1 << 17
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point, whether it is a letter (no surrogates)."""
    known = np.zeros(0x110000, bool)
    for at in (range(0xD800), range(0xE000, 0x110000)):
        known[at.start : at.stop] = np.fromiter((chr(c).isalpha() for c in at), bool, len(at))
    return known


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct trigram of each text: text, bucket, count; and of each text whether it has a letter.

    Runs of other characters count as one space, also before and after the text.
    """
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(lowered)))
    letter = _letters()[codes]
    has = np.zeros(len(texts), bool)
    has[text[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (text[1:] != text[:-1])
    keep[:1] = True
    codes, text = np.where(letter, codes, 32)[keep].astype(np.uint64), text[keep]
    if len(codes) < 3:
        return text[:0], text[:0], text[:0], has
    hashed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)
    inside = text[:-2] == text[2:]
    key, count = np.unique((text[:-2][inside] << BITS) | hashed[inside].astype(np.int64), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count, has


def _batched(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > CHARS:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def _mixture(count: np.ndarray, like: np.ndarray, start: np.ndarray, group: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and log-likelihoods after EM."""
    share = np.full((len(start), like.shape[1]), 1 / like.shape[1])
    for _ in range(ROUNDS):
        weighted = share[group] * like
        weighted *= (count / weighted.sum(axis=1))[:, None]
        share = np.add.reduceat(weighted, start) / total[:, None]
    return share, np.add.reduceat(count * np.log((share[group] * like).sum(axis=1)), start)


class Model:
    """Likelihoods ``like[bucket, language]`` of the learned languages."""

    def __init__(self, languages: list[str], like: np.ndarray):
        self.languages, self.like = languages, like

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        text, bucket, count, has = trigrams(texts)
        if len(text) and self.languages:
            start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            like, count = self.like[bucket], count.astype(float)
            total = np.add.reduceat(count, start)
            size = np.diff(np.r_[start, len(text)])
            group = np.repeat(np.arange(len(start)), size)
            alone = np.add.reduceat(count[:, None] * np.log(like), start)
            # The order in which languages may join: the best alone, then by their share after one step of EM.
            claim = np.add.reduceat(like * (count / like.sum(axis=1))[:, None], start)
            first = alone.argmax(axis=1)
            claim[np.arange(len(start)), first] = np.inf
            order = np.argsort(-claim, axis=1, kind="stable")
            found, share, fit = first.copy(), np.ones(len(start)), alone.max(axis=1)
            open_ = np.arange(len(start))
            for k in range(2, len(self.languages) + 1):
                rows = np.flatnonzero(np.isin(group, open_)) if len(open_) < len(start) else np.arange(len(group))
                if not len(rows):
                    break
                own = np.repeat(np.arange(len(open_)), size[open_])
                at = np.r_[0, np.cumsum(size[open_])[:-1]]
                part = np.take_along_axis(like[rows], order[open_][own, :k], axis=1)
                mixed, value = _mixture(count[rows], part, at, own, total[open_])
                better = value - fit[open_] > PENALTY * np.log(np.maximum(total[open_], 2))
                open_, mixed = open_[better], mixed[better]
                top = mixed.argmax(axis=1)
                found[open_], share[open_], fit[open_] = order[open_, top], mixed[np.arange(len(top)), top], value[better]
            where = text[start]
            best[where], score[where] = found, share
        best[~has], score[~has] = -1, 0
        return [self.languages[b] if b >= 0 else UNKNOWN for b in best], np.clip(score, 0, 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text has remainder 1 by 3; such rows are never learned from. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _counter(index: dict[str, int]):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(index), 1 << BITS), np.int64)
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, held in _batched(texts):
                lang = np.array([index[x] for x in langs[at : at + len(held)]])
                text, bucket, count, _ = trigrams(held)
                np.add.at(sums, (lang[text], bucket), count)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[lang, bucket])], ["lang", "bucket", "n"])

    return counts


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on the labelled rows of ``docs(doc_id, text, lang)`` that are not held out.

    First the ids are drawn from the narrow columns, then only their texts are read on; what reaches the driver is at most
    ``rows_per_language`` ids and 2**BITS counts for each language.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang")
    # Hashes are even, so the smallest ones of a language lie below a bound that follows from its number of rows; with room to
    # spare, only the rows below it are ordered, however many a language has.
    counts = known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    below = known.join(small(durable(counts)), F.col("lang") == F.col("of")).withColumn("place", place)
    below = below.where(F.col("place") / F.lit(2.0**63) < (2 * rows_per_language + 200) / F.col("n"))
    by_hash = Window.partitionBy("lang").orderBy("place", "doc_id")
    drawn = below.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= rows_per_language).select("doc_id", "lang").distinct().collect()
    languages = sorted({r.lang for r in drawn})
    if not languages:
        return Model([], np.ones((1 << BITS, 0)))
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.doc_id, r.lang) for r in drawn], "drawn_id long, drawn_lang string")
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("drawn_id")) & (F.col("lang") == F.col("drawn_lang")))
    sample = sample.groupBy("drawn_id", "lang").agg(F.min("text").alias("text"))  # rows under one id count once
    counted = sample.select("lang", "text").mapInArrow(lean(_counter({x: k for k, x in enumerate(languages)})), "lang int, bucket int, n long")
    sums = np.zeros((len(languages), 1 << BITS))
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        sums[r.lang, r.bucket] += r.n
    seen = sums.any(axis=1)  # a language of which only null texts were drawn is not learned
    languages, sums = [x for x, s in zip(languages, seen) if s], sums[seen] + SMOOTHING
    return Model(languages, np.ascontiguousarray((sums / sums.sum(axis=1, keepdims=True)).T))


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = [], []
            for _, held in _batched(texts):
                lang, score = model.predict(held)
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["row", "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row; only the text is an input of a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), "text").mapInArrow(_predictor(shared), "row long, lang_pred string, score double")
    return rows.select(F.col("row").alias("doc_id"), held_out("row").alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns kept, that have a language with at least the share ``least`` of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [n for n in docs_names].index("text")
        for batch in batches:
            kept: list[bool] = []
            for _, held in _batched(batch.column(at).to_pylist()):
                lang, score = shared.value.predict(held)
                kept += [x != UNKNOWN and s >= least for x, s in zip(lang, score)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    docs_names = docs.columns
    return docs.mapInArrow(lean(keep), docs.schema)
