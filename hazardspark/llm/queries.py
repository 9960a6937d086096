"""Registered queries of the training-data operators, with SQL checks where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardspark.llm import (
    chat, infill, langid, licenses, minhash, mixing, negatives, quality_rules, repeats, sentencepiece, sharding,
    simhash, toxicity,
)
from hazardspark.llm.common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 8


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@_query
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sentencepiece.encode(docs, verify=True)


@_query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = sharding.assign(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@_query
def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.compare_with_next(table(spark, folder, "documents"))


@_query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(langid.learnable(docs))
    found = langid.predict(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@_query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.MixPlan(table(spark, folder, "documents"))
    return plan.taken().select("doc_id", "size", "source_size", "target", "taken")


@_query
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = chat.rotate(table(spark, folder, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["length"])), ",")
    return rows.select("conv_id", "perspective", "chunk", "n_turns", "text", spans.alias("masks"), "text_start")


@_query
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"), licenses.known_digests(spark))


@_query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = quality_rules.fit(docs, table(spark, folder, "labels"))
    judged = quality_rules.judge(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", *[f"_stats.{c}" for c in quality_rules.BASE], "base_failed", "rule", "kept")


@_query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(table(spark, folder, "embeddings"))


@_query
def op12_infill(spark: SparkSession, folder: str) -> DataFrame:
    rows = infill.fill_in_middle(table(spark, folder, "documents"), digests=True)
    return rows.withColumnsRenamed({"output": "output_sha256", "restored": "restored_sha256"}).drop("segments")


@_query
def op13_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"), digests=True)


# The checksum of a text, byte by byte: 0xEDB88320 is the reversed polynomial of CRC-32.
_CRC_SQL = """
bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t),
sums AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
          lambda h: ('0x' || h)::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, bits)
"""


def _shard_sql(name: str, shards: int) -> str:
    return f"""
{name} AS (
  SELECT doc_id, arg_min(k, -ln((('0x' || substr(md5(doc_id::VARCHAR || '|' || k), 1, 13))::BIGINT + 0.5)
    / 4503599627370496.0))::INTEGER AS shard
  FROM documents, range({shards}) r(k) GROUP BY doc_id)"""


ORACLES["op3_sharding"] = f"""
WITH {_CRC_SQL}, {_shard_sql("now", SHARDS)}, {_shard_sql("later", SHARDS + 1)}
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32::BIGINT AS text_crc32, 'key' AS law, n.shard,
  row_number() OVER (PARTITION BY n.shard ORDER BY s.doc_id, s.size, s.text_crc32) - 1 AS slot,
  l.shard AS grown_shard
FROM sums s JOIN now n USING (doc_id) JOIN later l USING (doc_id)
"""

ORACLES["op8_chat"] = f"""
WITH turns AS (
  SELECT conv_id, turn, role AS speaker, coalesce(floor(turn / {chat.CHUNK})::BIGINT, -1) AS chunk,
    replace(coalesce(text, ''), '<|', '< |') || '{chat.CLOSE}' AS body
  FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
seen AS (
  SELECT t.*, perspective, speaker = perspective AS own,
    CASE WHEN speaker = perspective THEN '{chat.OPEN}assistant' WHEN speaker = 'system' THEN '{chat.OPEN}system'
      WHEN speaker IS NULL THEN '{chat.OPEN}user'
      ELSE '{chat.OPEN}user name=' || regexp_replace(speaker, '[^\\p{{L}}\\p{{N}}_-]+', '_', 'g') END || chr(10) AS head
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head || body)) OVER (PARTITION BY conv_id, perspective, chunk
    ORDER BY turn NULLS FIRST, speaker NULLS FIRST, head || body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot
  FROM seen),
chunks AS (
  SELECT conv_id, perspective, chunk, count(*) AS n_turns, sum(length(head || body)) AS size,
    string_agg(head || body, '' ORDER BY turn NULLS FIRST, speaker NULLS FIRST, head || body) AS text,
    coalesce(string_agg((spot + length(head)) || ':' || length(body), ',' ORDER BY spot) FILTER (WHERE own), '') AS masks
  FROM placed GROUP BY ALL)
SELECT conv_id, perspective, chunk, n_turns, text, masks,
  coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY chunk
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS text_start
FROM chunks
""".replace(chat.CLOSE, chat.CLOSE[:-1] + "' || chr(10) || '")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(licenses.COPYRIGHT_LINE)}, '', 'g')"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    other = licenses.OTHER_SIGNS.replace("\\n", "\n")
    return f"list_transform(string_split(regexp_replace({out}, {_quoted(other)}, ' ', 'g'), chr(10)), lambda x: trim(x))"


ORACLES["op9_licenses"] = f"""
WITH known_text(license, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.KNOWN)}),
known AS (
  SELECT DISTINCT license, sha256(array_to_string(list_filter({_canonical_sql("text")}, lambda x: x <> ''), ' ')) AS digest
  FROM known_text),
lines AS (SELECT doc_id, {_canonical_sql("text")} AS lines FROM documents),
units AS (
  SELECT doc_id, 'text' AS scope, 0 AS line, array_to_string(list_filter(lines, lambda x: x <> ''), ' ') AS canon FROM lines
  UNION ALL
  SELECT doc_id, 'line', unnest(range(1, len(lines) + 1))::INTEGER, unnest(lines) FROM lines),
found AS (
  SELECT u.doc_id, u.scope, u.line, sha256(u.canon) AS digest, k.license
  FROM units u LEFT JOIN known k ON k.digest = sha256(u.canon) WHERE u.scope = 'text' OR u.canon <> '')
SELECT * FROM found WHERE scope = 'text' OR license IS NOT NULL
"""

ORACLES["op11_hard_negatives"] = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, row_number() OVER () AS n
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, a.label = v.label AS same, v.n, v.vec_id,
    list_dot_product(a.e, v.e)::BIGINT AS score
  FROM v a JOIN v ON a.n <> v.n WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, n) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
  s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id NULLS LAST, s.n)::INTEGER AS rank
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same
  AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""

_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_DRAWS = ", ".join(f"('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))

ORACLES["op12_infill"] = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS t, {_DRAWS}
  FROM documents),
cuts AS (
  SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
      THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM texts),
parts AS (
  SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s
  FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
