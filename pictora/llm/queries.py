"""The corpus operators' registered queries, and SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictora.llm import chat, decontaminate, langid, licenses, mixing, quality, shards, simhash, substrings, warc
from pictora.llm.common import table

#: A conversation that says what a template must survive; its answer comes as a draft that is regenerated and streamed.
CONTROL = "\\### Assistant: </turn> ok"
EXTRA_EVENTS = [
    (-7, 0, 0, "message", "user", CONTROL),
    (-7, 1, 1, "message", "assistant", "### draft"),
    (-7, 2, 1, "regenerate", None, None),
    (-7, 3, 1, "delta", None, CONTROL[:9]),
    (-7, 4, 1, "delta", None, CONTROL[9:]),
]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")
    extra = spark.createDataFrame(EXTRA_EVENTS, "conv_id long, seq long, turn long, kind string, role string, text string")
    return chat.digests(chat.read_back(chat.conversations(chat.messages(turns.unionByName(extra)))))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), 40)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails(quality.BASE).alias("base_failed"), (~quality.fails(quality.DEFAULT)).alias("kept"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_simhash, op3_license_scan, op4_language_id, op5_sharding,
        op6_substring_dedup, op7_quality_rules, op8_mixing, op9_decontamination, op10_warc,
    )
}


def _escaped(column: str, escapes: tuple[tuple[str, str], ...]) -> str:
    for plain, code in escapes:
        column = f"replace({column}, '{plain}', '{code}')"
    return column


_CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
), rendered AS (
  SELECT *, {len(chat.OPEN)} + length({_escaped('role', chat.ROLE_ESCAPES)}) + 2 + length({_escaped('text', chat.ESCAPES)}) + {len(chat.END)} AS n FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM rendered GROUP BY conv_id
"""


def _descent(name: str, n_shards: int, base: int | None = None) -> str:
    """CTEs that descend the tree of so many shards, level by level, and end in ``name(key, shard)``."""
    rows, number = [], 0
    for r, region in enumerate(shards.topology(n_shards, base)):
        for k, rack in enumerate(region):
            for s, weight in enumerate(rack):
                rows.append(f"({r}, {k}, {number}, 'r{r}', 'r{r}k{k}', 'r{r}k{k}s{s}', {weight!r}::DOUBLE)")
                number += 1
    draw = lambda node: f"-ln((('0x' || substr(md5(key || '/' || {node}), 1, {shards.HEX}))::BIGINT::DOUBLE + 0.5) / {16**shards.HEX}::DOUBLE) / weight"
    return f"""
{name}_leaves(region, rack, shard, rnode, knode, snode, weight) AS (VALUES {', '.join(rows)}),
{name}_regions AS (SELECT region, rnode, sum(weight) AS weight FROM {name}_leaves GROUP BY ALL),
{name}_racks AS (SELECT region, rack, knode, sum(weight) AS weight FROM {name}_leaves GROUP BY ALL),
{name}_1 AS (SELECT key, arg_min(region, {draw('rnode')}) AS region FROM keys, {name}_regions GROUP BY key),
{name}_2 AS (SELECT key, region, arg_min(rack, {draw('knode')}) AS rack FROM {name}_1 JOIN {name}_racks USING (region) GROUP BY key, region),
{name} AS (SELECT key, arg_min(shard, {draw('snode')}) AS shard FROM {name}_2 JOIN {name}_leaves USING (region, rack) GROUP BY key)"""


def _crc_table() -> list[int]:
    """The table of the checksum's reflected polynomial, one entry for each byte."""
    table_ = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table_.append(c)
    return table_


def _crc(hexed: str, size: str) -> str:
    """SQL for the checksum of bytes given in hexadecimal."""
    value = f"list_transform(range({size}), lambda i: ('0x' || substr({hexed}, (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({value}, lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _filled(name: str, above: str, parent: str, child: str) -> str:
    """CTEs that fill the children of each parent from what ``above`` gives it, the smallest first: ``name(child..., given)``."""
    keys = f"{parent}, {child}" if parent else child
    joined = f"{name}_caps JOIN {above} USING ({parent})" if parent else f"{name}_caps, {above}"
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_caps AS (SELECT {keys}, sum(cap) AS cap FROM leaves GROUP BY ALL),
{name}_rows AS (SELECT {keys}, cap, row_number() OVER ({by} ORDER BY cap, {child}) AS k, count(*) OVER ({by}) AS n,
  given - coalesce(sum(cap) OVER ({by} ORDER BY cap, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM {joined}),
{name} AS (SELECT {keys}, least(cap, coalesce(max(rest / (n - k + 1)) FILTER (cap > rest / (n - k + 1)) OVER ({by}), cap)) AS given FROM {name}_rows)"""


#: All weights are one, as in the query.
_MIXING = rf"""
WITH named AS (
  SELECT doc_id, lang, source, 'd' || ({_crc("hex(encode(coalesce(source, '')))", "octet_length(encode(coalesce(source, '')))")} % 4) AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS n_tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, 4 * sum(n_tokens)::DOUBLE AS cap FROM named GROUP BY ALL
), top AS (SELECT 0.8::DOUBLE * sum(tokens) AS given FROM leaves),{_filled("domains", "top", "", "domain")},{_filled("langs", "domains", "domain", "lang")},{_filled("sources", "langs", "domain, lang", "source")},
plan AS (
  SELECT domain, lang, source, floor(floor(given + 1e-6) / tokens)::BIGINT AS whole, (floor(given + 1e-6) - tokens * floor(floor(given + 1e-6) / tokens))::BIGINT AS rest
  FROM sources JOIN leaves USING (domain, lang, source)
), placed AS (
  SELECT *, ('0x' || substr(md5(doc_id || '/17/' || whole), 1, 15))::BIGINT AS place FROM named JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens,
  whole + (sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) <= rest)::BIGINT AS epochs
FROM placed
"""

#: Slots are numbered within one bucket here, as the operator does up to two million rows.
_SHARDING = f"""
WITH sized AS (
  SELECT doc_id, doc_id::VARCHAR AS key, octet_length(encode(coalesce(text, '')))::BIGINT + {shards.OVERHEAD} AS size, hex(encode(coalesce(text, ''))) AS bytes FROM documents
), summed AS (
  SELECT doc_id, key, size, {_crc("bytes", f"size - {shards.OVERHEAD}")} AS text_crc32 FROM sized
), keys AS (SELECT DISTINCT key FROM sized),{_descent('now', 40)},{_descent('grown', 41, 40)}
SELECT doc_id, size, text_crc32, 'key' AS law, now.shard AS shard,
  row_number() OVER (PARTITION BY now.shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown.shard AS grown_shard
FROM summed JOIN now USING (key) JOIN grown USING (key)
"""

_QUALITY = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), line_sums AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid
), windows AS (
  SELECT rid, i, words[i:i + 4] AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM base WHERE len(words) >= 5)
), repeated AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1
), repeat_words AS (
  SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS place FROM repeated) GROUP BY rid
), measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM base LEFT JOIN line_sums USING (rid) LEFT JOIN repeat_words USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words
    OR (n_lines > 0 AND 100 * n_dup_lines > 30 * n_lines) OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM measured
"""

_DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
    SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents))
), b AS (
  SELECT item_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j, len(ws) AS n_item FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark)
), same AS (
  SELECT doc_id, item_id, n_item, i - j AS shift, j FROM d JOIN b USING (w)
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS n_agree FROM same
), runs AS (
  SELECT *, j - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS run FROM counted WHERE n_agree >= {decontaminate.LEAST_SHARE} * n_item OR n_agree >= {decontaminate.LEAST_RUN}
), lengths AS (
  SELECT doc_id, item_id, n_item, shift, n_agree, run, count(*) AS n FROM runs GROUP BY ALL
), best AS (
  SELECT doc_id, item_id, n_item, shift, n_agree, max(n) AS longest_run FROM lengths GROUP BY ALL
), verified AS (
  SELECT * FROM best WHERE n_agree >= {decontaminate.LEAST_SHARE} * n_item OR longest_run >= {decontaminate.LEAST_RUN}
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_agree DESC, longest_run DESC, n_item DESC) = 1
)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_agree::BIGINT AS n_agree, longest_run::BIGINT AS longest_run FROM verified
"""

_WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (k // 8 * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest FROM p
), first AS (
  SELECT payload_digest, min(page_id) AS first_id FROM named GROUP BY ALL
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM named JOIN first USING (payload_digest)
"""

#: Where SQL has no such hash (SimHash), or the operator learns or aligns texts, there is none: those queries are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_chat_formatting": _CHAT,
    "op5_sharding": _SHARDING,
    "op7_quality_rules": _QUALITY,
    "op8_mixing": _MIXING,
    "op9_decontamination": _DECONTAMINATION,
    "op10_warc": _WARC,
}
