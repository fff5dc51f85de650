"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts become sequences of lower-cased words of letters and digits. A mask of ones and zeros laid over consecutive words
names a seed: the hash of the words under the ones, so that words under the zeros may differ. The seeds of the test items
(a stated query set) are held in blocks of a bounded, counted size and met by every position of every training text. Around each
hit the item is laid over the text on the hit's diagonal and compared word by word: a document is contaminated if the
words that agree are at least the share ``LEAST_SHARE`` of the item, or if at least ``LEAST_RUN`` of them agree in a row.

Every item of five words or more is found exactly. Items of five to thirteen words have short masks, which find them with any
words substituted that the rule allows: of the n - 3 places of the mask 1101 a substituted word spoils three at most, and at five words, where that
may be all, 1011 is left. Longer items have wide masks, which find any two words substituted, and more of them mostly. Items under five
words are looked up as a whole.

Defined cases: null and empty texts and items match nothing; repeated documents and items are matched each, and rows with one
(doc_id, item_id) are one result; texts of any length are searched whole; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictora.llm.common import durable

MASKS = ("11111", "1101011", "110010011")
#: Masks of items of fewer than LONG words, and the least words of an item that has masks.
SHORT_MASKS = ("1101", "1011")
LONG, LEAST = 14, 5
LEAST_SHARE = 0.8
LEAST_RUN = 13
#: Seeds of test items that are broadcast at a time, of 48 bytes each; their items' words go with them.
BLOCK_SEEDS = 500_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _key(mask: str, at: str = "at") -> str:
    """SQL for the seed of one mask at a position of ``words``; null where the mask reaches beyond either end."""
    picked = ", ".join(f"get(words, {at} + {k})" for k, bit in enumerate(mask) if bit == "1")
    return f"if({at} >= 0 and {at} + {len(mask)} <= size(words), xxhash64('{mask}', {picked}), null)"


def _seeds(rows: DataFrame, keep: list[str], masks: list[str]) -> DataFrame:
    """``keep``, ``words``, the position ``at``, the mask's number and the seed ``key`` of each position and mask of ``words``."""
    spread = rows.select(*keep, "words", F.explode(F.expr("if(size(words) > 0, sequence(0, size(words) - 1), cast(array() as array<int>))")).alias("at"))
    keys = F.posexplode(F.expr(f"array({', '.join(map(_key, masks))})")).alias("mask", "key")
    return spread.select(*keep, "words", "at", keys).where("key is not null")


def _before(masks: list[str]) -> Column:
    """The seed of the same mask one position before."""
    return F.expr("case mask " + " ".join(f"when {k} then {_key(m, '(at - 1)')}" for k, m in enumerate(masks)) + " end")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified overlaps ``(doc_id, item_id, n_item, n_agree, longest_run)`` of ``docs(doc_id, text)`` and ``items(item_id, text)``.

    Of hits that follow each other on one diagonal only the first goes on, with the stretch of words that the item covers, so
    the number of rows made does not grow with the length of what is shared, nor their width with the length of a text.
    """
    asked = durable(items.select("item_id", tokens(F.col("text")).alias("words")).where("size(words) > 0").withColumn("item", F.monotonically_increasing_id()))
    # Each mask with the sizes of the items that have it; masks that no item has are left out. An item too short for masks has one seed of its own length.
    n = F.size("words")
    sizes = asked.agg(F.max(n >= LONG).alias("long"), F.max((n >= LEAST) & (n < LONG)).alias("mid"), F.collect_set(F.when(n < LEAST, n)).alias("short")).first()
    of_size = [(m, n >= LONG) for m in MASKS if sizes.long] + [(m, (n >= LEAST) & (n < LONG)) for m in SHORT_MASKS if sizes.mid] + [("1" * k, n == k) for k in sorted(sizes.short)]
    of_size = of_size or [(MASKS[0], n >= LONG)]
    masks = [m for m, _ in of_size]
    whole = F.lit(False)
    for k, (_, has) in enumerate(of_size):
        whole = whole | ((F.col("mask") == k) & has)
    seeds = _seeds(asked, ["item"], masks).where(whole)
    seeds = durable(seeds.select("item", F.size("words").alias("n_item"), F.col("mask").alias("item_mask"), F.col("at").alias("item_at"), F.col("key").alias("item_key"), _before(masks).alias("item_before")))
    blocks = max(1, -(-seeds.count() // BLOCK_SEEDS))
    train = _seeds(docs.select("doc_id", tokens(F.col("text")).alias("words")), ["doc_id"], masks)
    of_block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = None
    for block in range(blocks):
        hits = train.join(F.broadcast(seeds.where(of_block == block)), (F.col("key") == F.col("item_key")) & (F.col("mask") == F.col("item_mask")))
        hits = hits.where(F.col("item_before").isNull() | ~F.col("item_before").eqNullSafe(_before(masks))).withColumn("shift", F.col("at") - F.col("item_at"))
        hits = hits.select("doc_id", "item", "n_item", F.least("shift", F.lit(0)).alias("off"), F.expr("slice(words, greatest(shift, 0) + 1, n_item)").alias("stretch"))
        laid = hits.join(F.broadcast(asked.where(of_block == block).select("item", "item_id", F.col("words").alias("item_words"))), "item")
        agree = F.expr("transform(item_words, (w, k) -> if(off + k >= 0, w <=> get(stretch, off + k), false))")
        seen = laid.select("doc_id", "item_id", "n_item", agree.alias("agree"))
        run = F.expr("aggregate(agree, struct(0 as now, 0 as best), (s, x) -> struct(if(x, s.now + 1, 0) as now, greatest(s.best, if(x, s.now + 1, 0)) as best), s -> s.best)")
        seen = seen.select("doc_id", "item_id", "n_item", F.expr("size(filter(agree, x -> x))").alias("n_agree"), run.alias("longest_run"))
        seen = seen.where((F.col("n_agree") >= LEAST_SHARE * F.col("n_item")) | (F.col("longest_run") >= LEAST_RUN))
        found = seen if found is None else found.unionByName(seen)
    best = F.max(F.struct("n_agree", "longest_run", "n_item"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", *(F.col(f"best.{c}").cast("long").alias(c) for c in ("n_item", "n_agree", "longest_run")))
