"""Mixing sources to target weights by hierarchical budgeting.

The leaves are (domain, lang, source). A token budget is handed down the tree by the children's weights. A child that cannot
use its part (it has fewer tokens, times the epochs allowed) gives the rest to its siblings; only what the siblings cannot
take either returns to the ancestors and goes to their other children. A leaf spends its budget on whole epochs over its
documents and then on a prefix of one more epoch, in the order of a hash seeded with that epoch's number.

The prefix is found without sorting a leaf: the hash's high bits cut a leaf into buckets of some ``BUCKET_ROWS`` rows, the buckets' token sums
say which lie wholly within the budget, and only the one bucket in which the budget ends is ordered row by row.

What reaches the driver is one row for each leaf (domain, language and source), not for each document.

Defined cases: a null text has no tokens; null languages and sources are leaves of their own; repeated rows are separate
rows that stand next to each other; equal hashes are ordered by doc_id; weights not given are 1; leaves of weight 0 are left out; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pictora.llm.common import WORD, durable

BUCKET_ROWS = 20_000
LEVELS = ("domain", "lang", "source")


def domain_of(source: str = "source", domains: int = 4) -> Column:
    """The domain a source belongs to where no column says so: its checksum by the number of domains."""
    return F.concat(F.lit("d"), F.crc32(F.coalesce(F.col(source), F.lit("")).cast("binary")) % domains)


def _share(budget: float, children: dict, capacity: Mapping, weight: Mapping) -> dict:
    """Water-filling: parts by weight; what a full child leaves goes to the others."""
    given, open_ = dict.fromkeys(children, 0.0), [c for c in children if weight[c] > 0]
    while open_ and budget > 0:
        total = sum(weight[c] for c in open_)
        full = [c for c in open_ if capacity[c] <= budget * weight[c] / total]
        if not full:
            return given | {c: budget * weight[c] / total for c in open_}
        for c in full:
            given[c] = capacity[c]
        budget -= sum(capacity[c] for c in full)
        open_ = [c for c in open_ if c not in full]
    return given


def budgets(leaves: Mapping[tuple, float], budget: float, weights: Mapping[tuple, float] | None = None) -> dict[tuple, float]:
    """The budget of each leaf (a path), from its capacity; ``weights`` by path of leaf or inner node."""
    weights = weights or {}
    weight = lambda path: float(weights.get(path, 1.0))
    usable = {p: c for p, c in leaves.items() if all(weight(p[:k]) > 0 for k in range(1, len(p) + 1))}
    given = dict.fromkeys(leaves, 0.0)

    def hand_down(path: tuple, amount: float) -> None:
        if path in usable:
            given[path] = min(amount, usable[path])
            return
        below: dict[tuple, float] = {}
        for p, c in usable.items():
            if p[: len(path)] == path:
                child = p[: len(path) + 1]
                below[child] = below.get(child, 0.0) + c
        for child, part in _share(amount, below, below, {c: weight(c) for c in below}).items():
            hand_down(child, part)

    if usable:
        hand_down((), budget)
    return given


def place(seed: int) -> Column:
    """Where a document stands in the epoch after its leaf's whole ones: sixty bits of a digest."""
    named = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)), F.col("whole").cast("string"))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def select(docs: DataFrame, share: float = 0.8, max_epochs: int = 4, weights: Mapping[tuple, float] | None = None, seed: int = 17, domain: Column | None = None) -> DataFrame:
    """``(doc_id, domain, lang, source, n_tokens, epochs)`` for each row: how often the mix takes it, 0 if never.

    The budget is the given share of all tokens.
    """
    rows = docs.select("doc_id", (domain_of() if domain is None else domain).alias("domain"), "lang", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    rows = durable(rows)
    leaves = {tuple(r[k] for k in LEVELS): (r.tokens, r.n) for r in rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    given = budgets({p: t * max_epochs for p, (t, _) in leaves.items()}, share * sum(t for t, _ in leaves.values()), weights)
    plan = []
    for path, (total, n) in leaves.items():
        whole, rest = divmod(int(given[path] + 1e-6), total) if total else (0, 0)
        plan.append((*path, whole, rest, max(1, -(-n // BUCKET_ROWS))))
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, "p_domain string, p_lang string, p_source string, whole long, rest long, buckets long")
    same = [rows[k].eqNullSafe(plan[f"p_{k}"]) for k in LEVELS]
    rows = rows.join(plan, same[0] & same[1] & same[2]).drop("p_domain", "p_lang", "p_source")
    rows = rows.withColumn("place", place(seed)).withColumn("bucket", F.shiftright(F.shiftright("place", 28) * F.col("buckets"), 32))
    up_to = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("tokens")).withColumn("after", F.sum("tokens").over(up_to))
    sums = sums.select(*(F.col(k).alias(f"s_{k}") for k in LEVELS), F.col("bucket").alias("s_bucket"), F.col("after"), (F.col("after") - F.col("tokens")).alias("before"))
    on = rows["bucket"] == sums["s_bucket"]
    for k in LEVELS:
        on = on & rows[k].eqNullSafe(sums[f"s_{k}"])
    rows = rows.join(sums, on)
    result = [*(F.col(c) for c in ("doc_id", *LEVELS, "n_tokens"))]
    cut = (F.col("before") < F.col("rest")) & (F.col("after") > F.col("rest"))
    clear = rows.where(~cut).select(*result, (F.col("whole") + (F.col("after") <= F.col("rest")).cast("long")).alias("epochs"))
    running = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.where(cut).withColumn("taken", F.col("before") + running <= F.col("rest")).select(*result, (F.col("whole") + F.col("taken").cast("long")).alias("epochs"))
    return clear.unionByName(edge)
