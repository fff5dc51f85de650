"""Near copies: texts whose five-word shingles have a similarity (Jaccard) of 0.8 or more, closed transitively.

Texts that are equal but for case and white space are one node, named by a 64-bit hash; texts without words are copies of one another.
The classes are found in three steps, of which each joins only what an exact check of the whole shingle sets has confirmed:

1. SimHash. The nodes' 64-bit prints over five-word shingles meet in the Gray-order index of ``pictora.llm.simhash``. That links the
   closest texts, and how many links a text has tells the centre of a group from its fringe.
2. Centres. Of a text's n shingles, in one order for all texts, the first n - ceil(0.8 n) + 1 are its prefix: two texts that similar
   share a shingle of their prefixes. The order puts shingles first that a sample does not have often; any order is exact, this one
   keeps common phrases out of the prefixes. Each text is checked against the most linked and the smallest text of each of
   its prefix shingles, which joins a large group at two rows for each shingle.
3. The rest. Of each prefix shingle that texts of several classes have, the texts outside its largest class meet all texts of it, in cells
   of ``SQUARE`` by ``SQUARE``: pairs of one class are never made, and no task holds a whole group. Pairs of different classes are
   checked on the whole sets but for those that sizes or sketches rule out (in a sketch each shingle flips one bit, so no more bits
   differ than shingles). No number of candidates or partners is bounded.

A prefix is kept whole however long its text is, so no pair depends on chance; the sample decides about work alone.

Defined cases: null text is one without words; fewer than five words are one shingle; repeated rows are rows of one class; a row is known by its
id and its text's hash, so that rows with null or repeated ids are judged each by its own text; a class is named by its smallest doc_id, a null
id only where it has no other; an empty table gives an empty result; texts of any length are used whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pictora.llm.common import Tables, components, durable, lean, small, tidy
from pictora.llm.simhash import links, majority

WORDS = 5
#: 64-bit words of a short sketch, at least and at most.
SKETCH = 8
LONG_SKETCH = 64
#: Texts on either side of a cell, pairs looked at together, and bytes of sketches gathered before that.
SQUARE = 1024
PAIRS = 1 << 18
HELD = 8 << 20
#: Texts of the sample that orders shingles, and the most shingles it tells apart.
SAMPLE = 20_000
COMMON = 100_000
#: Differing bits of prints that the Gray-order index links.
DISTANCE = 2


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(text: bytes | None, words: int = WORDS) -> tuple[int, np.ndarray]:
    """Hash of the text's words in lower case, and the distinct hashes of its shingles (fewer words: the whole sequence), sorted."""
    found = text.lower().split() if text else []
    if not found:
        return 0, np.empty(0, np.uint64)
    joined = b" ".join(found)
    name = xxhash.xxh64_intdigest(joined)
    if len(found) <= words:
        return name, np.array([name], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = len(each) - words + 1
    value = np.zeros(n, np.uint64)
    for k in range(words):
        value = _mixed(value + each[k : k + n])
    return name, np.unique(value)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each bit: two sets differ in at least as many members as their sketches in bits.

    The bits are a power of two, at least two for each shingle; ``folded`` gives the sketch of fewer bits.
    """
    bits = max(64 * SKETCH, 1 << (2 * len(shingles) - 1).bit_length())
    at = (_mixed(shingles) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1).view(np.int64)


def folded(wide: np.ndarray, words: int = SKETCH) -> np.ndarray:
    return np.bitwise_xor.reduce(wide.reshape(-1, words), axis=0)


def prefix(shingles: np.ndarray, common: np.ndarray, weight: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in order of (weight, hash), as many as a similar set cannot lack, and their places; ``common`` is sorted, others weigh nothing."""
    n = len(shingles)
    if not n:
        return shingles, np.empty(0, np.int64)
    weights = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        weights = np.where(common[at] == shingles, weight[at], 0)
    found = shingles[np.lexsort((shingles, weights))[: n - math.ceil(similarity * n - 1e-9) + 1]]
    return found, np.arange(len(found))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _signer(common: np.ndarray, weight: np.ndarray, similarity: float):
    names = ["doc_id", "key", "node", "n", "print", "sketch", "wide", "prefix", "places"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, numbers, sketches, wides, prefixes, places = whole.slice(at, 256), [], [], [], [], []
                for text in batch.column(2):
                    name, shingles = shingle_hashes(text.as_py())
                    wide = sketch(shingles)
                    words = min(max(SKETCH, (1 << (max(1, len(shingles)) - 1).bit_length()) // 64), LONG_SKETCH)
                    numbers.append([_signed(name), len(shingles), _signed(majority(shingles))])
                    sketches.append(folded(wide, words).tobytes())
                    wides.append(wide.tobytes())
                    found, at_places = prefix(shingles, common, weight, similarity)
                    prefixes.append(found.view(np.int64))
                    places.append(at_places.astype(np.int32))
                columns = [*map(pa.array, np.array(numbers, np.int64).T), pa.array(sketches, pa.binary()), pa.array(wides, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return sign


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            name, shingles = shingle_hashes(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([_signed(name)], pa.int64()), pa.array([shingles.view(np.int64)], pa.list_(pa.int64()))], ["node", "shingles"])


def _common(source: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts has more than once, sorted, and in how many texts of it."""
    every = max(1, source.count() // SAMPLE)
    texts = source.where(F.pmod("key", F.lit(every)) == 0).select("text").distinct()
    counts = texts.mapInArrow(lean(_shingled), "node long, shingles array<long>").select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    shingles, weight = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    order = np.argsort(shingles.view(np.uint64))
    return shingles.view(np.uint64)[order], weight[order]


class Sketches:
    """Rows' sketches of several widths, compared at the narrower width of a pair; widths of a pair differ by a factor of two at most."""

    def __init__(self, values: list[bytes]):
        self.words = np.fromiter(map(len, values), np.int64, len(values)) // 8
        self.start = np.cumsum(self.words) - self.words
        self.buffer = np.frombuffer(b"".join(values), np.uint64)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _level(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        if words not in self.levels:
            place = np.full(len(self.words), -1)
            rows = np.flatnonzero((self.words == words) | (self.words == 2 * words))
            place[rows] = np.arange(len(rows))
            table = self.buffer[self.start[rows][:, None] + np.arange(words)]
            wide = self.words[rows] == 2 * words
            table[wide] ^= self.buffer[self.start[rows[wide]][:, None] + words + np.arange(words)]
            self.levels[words] = place, table
        return self.levels[words]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the rows' sketches differ."""
        out, least = np.zeros(len(i), np.int64), np.minimum(self.words[i], self.words[j])
        for words in np.unique(least).tolist():
            place, table = self._level(words)
            pairs = np.flatnonzero(least == words)
            for at in range(0, len(pairs), step := max(1, (1 << 20) // words)):
                p = pairs[at : at + step]
                out[p] = np.bitwise_count(table[place[i[p]]] ^ table[place[j[p]]]).sum(axis=1, dtype=np.int64)
        return out


def _similar(similarity: float):
    """Of rows ``(shingle, a, b, side, node, place, root, n, sketch)`` sorted by the first four, pairs across the sides of a cell whose roots differ and that sizes, places and sketches allow.

    The places: of sets of n and m members with an overlap of o or more, the first n - o + 1 of one and the first m - o + 1 of the other have a member in common.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], list[bytes]]] = []
        size, limit = 0, HELD

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            columns = [np.concatenate(x) for x in zip(*(c for c, _ in held))]
            values = [v for _, part in held for v in part]
            shingle, a, b, side, node, place, root, n = columns
            start = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            end = len(shingle) if final else int(start[-1])
            held, size = ([] if final or end == len(shingle) else [([c[end:] for c in columns], values[end:])]), sum(map(len, values[end:]))
            if not end:
                return
            sketches = Sketches(values[:end])
            reach = n - place
            length = np.diff(np.r_[start, len(shingle)])
            left = np.add.reduceat((side == 0).astype(np.int64), start)
            middle = np.repeat(start + left, length)[:end]
            many = np.where(side[:end] == 0, np.repeat(length - left, length)[:end], 0)
            ends, at = np.cumsum(many), 0
            while at < end:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                count = many[at:to]
                i = np.repeat(np.arange(at, to), count)
                j = middle[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                at = to
                fits = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                fits &= (side[j] == 1) | (node[i] < node[j])  # two outside the largest class meet twice
                i, j = i[fits], j[fits]
                overlap = np.ceil((n[i] + n[j]) * similarity / (1 + similarity) - 1e-9)
                fits = (reach[i] >= overlap) & (reach[j] >= overlap)
                i, j = i[fits], j[fits]
                fits = sketches.apart(i, j) <= (n[i] + n[j]) * (1 - similarity) / (1 + similarity) + 1e-9
                found = np.unique(np.stack([np.maximum(node[i], node[j])[fits], np.minimum(node[i], node[j])[fits]]), axis=1)
                if found.size:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["u", "v"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                held.append(([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], batch.column(8).to_pylist()))
                size += batch.column(8).nbytes
                if size >= limit:
                    yield from flush(False)
                    limit = max(HELD, 2 * size)
        if held:
            yield from flush(True)

    return pairs


class Links:
    """Checks pairs of nodes on their whole shingle sets."""

    def __init__(self, source: DataFrame, nodes: DataFrame, tables: Tables, similarity: float):
        self.source, self.nodes, self.tables, self.similarity = source, nodes, tables, similarity

    def of(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(u, v)`` that are similar enough."""
        similarity, nodes = self.similarity, self.nodes.select("node", "n", "wide")
        found = durable(self._both(durable(pairs), nodes).mapInArrow(lean(_allowed(similarity)), "u long, v long"))
        used = durable(found.select(F.explode(F.array("u", "v")).alias("used")).distinct())
        used = durable(self.nodes.select("node", "first.key").join(small(used), F.col("node") == F.col("used")).select("used", "key"))
        # Equal hashes of texts are told apart by the names that the texts give.
        texts = self.source.join(small(durable(used.select(F.col("key").alias("used_key")).distinct())), F.col("key") == F.col("used_key"), "left_semi").select("text")
        sets = texts.mapInArrow(lean(_shingled), "node long, shingles array<long>")
        name = self.tables.name()
        sets = self.tables.write(sets.join(small(used.select("used")), F.col("node") == F.col("used"), "left_semi").dropDuplicates(["node"]), name)
        shared = F.size(F.array_intersect("shingles_u", "shingles_v"))
        out = durable(self._both(found, sets).where(shared >= similarity * (F.size("shingles_u") + F.size("shingles_v") - shared) - 1e-9).select("u", "v"))
        self.tables.drop(name)
        return out

    def _both(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The (computed) pairs with the columns of both nodes; where the pairs are few, only what belongs to them is shuffled."""
        few, columns = small(pairs), [c for c in nodes.columns if c != "node"]
        u, v = (nodes.join(few, F.col("node") == F.col(x)).select("u", "v", *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in ("u", "v"))
        return u.join(v, ["u", "v"])


def _allowed(similarity: float):
    """Of rows ``(u, v, n_u, wide_u, n_v, wide_v)`` the pairs that sizes and the wide sketches allow."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
                most, keep = (n + m) * (1 - similarity) / (1 + similarity) + 1e-9, np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
                for k in np.flatnonzero(keep).tolist():
                    x, y = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (3, 5))
                    words = min(len(x), len(y))
                    keep[k] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64) <= most[k]
                yield batch.select([0, 1]).filter(pa.array(keep))

    return fit


def _by_prints(nodes: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of nodes whose prints the Gray-order index links: each print's smallest node, and the others with it."""
    heads = durable(nodes.groupBy("print").agg(F.min("node").alias("head"), F.count("*").alias("many")))
    linked = durable(links(heads.select(F.col("print").alias("fp")), DISTANCE))
    ends = linked.join(heads.select(F.col("print").alias("u"), F.col("head").alias("head_u")), "u").join(heads.select(F.col("print").alias("v"), F.col("head").alias("head_v")), "v")
    equal = nodes.select("node", F.col("print").alias("of")).join(heads.where("many > 1"), F.col("of") == F.col("print")).where("node <> head")
    return ends.select(F.greatest("head_u", "head_v").alias("u"), F.least("head_u", "head_v").alias("v")).unionByName(equal.select(F.col("node").alias("u"), F.col("head").alias("v")))


def _cells(met: DataFrame, rooted: DataFrame, tables: Tables) -> DataFrame:
    """``(shingle, a, b, side, node, place)``: of each shingle of several classes, the texts outside its largest class (side 0) and those they meet (side 1; 2 if outside as well)."""
    classed = tables.write(met.select("shingle", "node", "place").join(rooted.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of")).select("shingle", "node", "place", "root"), "classed")
    sizes = classed.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("shingle").agg(F.sum("n").alias("many"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
    mixed = tables.write(mixed.select(F.col("shingle").alias("of"), "many", (F.col("many") - F.col("top.n")).alias("few"), F.col("top.root").alias("top")), "mixed")
    rows = classed.join(mixed, F.col("shingle") == F.col("of")).withColumn("outside", F.col("root") != F.col("top"))
    a, b = (F.ceil(F.col(c) / SQUARE).cast("int") for c in ("few", "many"))
    to = lambda n: F.sequence(F.lit(0), n - 1)
    left = rows.where("outside").select("shingle", F.pmod(F.xxhash64("node"), a).cast("int").alias("a"), F.explode(to(b)).alias("b"), F.lit(0).alias("side"), "node", "place")
    right = rows.where("not outside or few > 1").select("shingle", F.explode(to(a)).alias("a"), F.pmod(F.xxhash64("node", F.lit(1)), b).cast("int").alias("b"), F.when(F.col("outside"), 2).otherwise(1).alias("side"), "node", "place")
    return left.unionByName(right)


def near_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, key, component_id, lead)`` for each row of ``docs(doc_id, text)``: classes of texts joined by checked links of that similarity or more.

    ``key`` is the text's hash; ``lead`` says that the row is its class's first one (or one of several that are equal to it).
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    text = F.col("text").cast("binary")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    signed = source.select("doc_id", "key", "text").mapInArrow(lean(_signer(*_common(source), similarity)), "doc_id long, key long, node long, n long, print long, sketch binary, wide binary, prefix array<long>, places array<int>")
    wide = tables.write(signed, "wide")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    nodes = tables.write(wide.groupBy("node").agg(first.alias("first"), *[F.first(x).alias(x) for x in ("n", "print", "sketch", "wide", "prefix", "places")]), "nodes")
    rows = tables.write(wide.select("doc_id", "key", "node"), "rows")
    tables.drop("wide")
    checked = Links(source, nodes, tables, similarity)

    close = checked.of(_by_prints(nodes))
    tidy(spark)
    degree = durable(close.select(F.explode(F.array("u", "v")).alias("linked")).groupBy("linked").agg(F.count("*").alias("degree")))
    tokens = nodes.join(small(degree), F.col("node") == F.col("linked"), "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.explode("prefix").alias("shingle"))
    counts = tokens.groupBy("shingle").agg(F.count("*").alias("many"), F.max(F.struct("degree", "node"))["node"].alias("hub"), F.min("node").alias("low")).where("many > 1")
    counts = tables.write(counts.select(F.col("shingle").alias("of"), "hub", "low"), "counts")
    placed = nodes.select("node", F.explode(F.arrays_zip("prefix", "places")).alias("at")).select("node", F.col("at.prefix").alias("shingle"), F.col("at.places").alias("place"))
    met = tables.write(placed.join(counts, F.col("shingle") == F.col("of")).select("shingle", "node", "place", "hub", "low"), "met")
    tables.drop("counts")
    star = met.select("node", F.explode(F.array("hub", "low")).alias("hub")).where("node <> hub")
    central = checked.of(star.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct())
    tidy(spark)

    root = components(close.unionByName(central)).select(F.col("node").alias("linked"), "root")
    rooted = tables.write(nodes.select("node", "n", "sketch").join(root, F.col("node") == F.col("linked"), "left").select("node", "n", "sketch", F.coalesce("root", "node").alias("root")), "rooted")
    cells = _cells(met, rooted, tables).join(rooted, "node").select("shingle", "a", "b", "side", "node", "place", "root", "n", "sketch")
    cells = cells.repartition("shingle", "a", "b").sortWithinPartitions("shingle", "a", "b", "side")
    rest = checked.of(durable(cells.mapInArrow(lean(_similar(similarity)), "u long, v long").distinct()))
    tidy(spark)

    joined = root.where("linked <> root").select(F.col("linked").alias("u"), F.col("root").alias("v")).unionByName(rest)
    final = components(joined).select(F.col("node").alias("linked"), "root")
    named = nodes.select("node", "first").join(final, F.col("node") == F.col("linked"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    classes = named.groupBy("root").agg(F.min("first").alias("lead"))
    named = durable(named.join(classes, "root").select(F.col("node").alias("named"), "lead"))
    lead = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("key") == F.col("lead.key"))
    out = durable(rows.join(named, F.col("node") == F.col("named")).select("doc_id", "key", F.col("lead.doc_id").alias("component_id"), lead.alias("lead")))
    tables.drop()
    tidy(spark)
    return out


def representatives(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class of ``found``, all columns kept: its lead; of equal rows (id and text) one, which is only sorted for where there are such."""
    key = lambda: F.xxhash64(F.col("text").cast("binary"))
    gone = small(durable(found.where("not lead").select(F.col("doc_id").alias("__gone_id"), F.col("key").alias("__gone_key")).distinct()))
    kept = docs.withColumn("__key", key())
    kept = kept.join(gone, kept["doc_id"].eqNullSafe(gone["__gone_id"]) & (F.col("__key") == F.col("__gone_key")), "left_anti")
    if not found.where("lead").groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        order = Window.partitionBy("doc_id", "__key").orderBy("text")
        kept = kept.withColumn("__row_of_id", F.row_number().over(order)).where("__row_of_id = 1").drop("__row_of_id")
    return kept.drop("__key")
