"""The queries op1_ to op10_ and pipeline over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, chat, divergence, embed, langid, mixing, packing, periods, simhash, suffix, topk, toxicity, warc
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.conversation_digests(chat.format_turns(rows))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity_drill(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embedding_groups(table(spark, sf_dir, "embeddings"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _planted_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Every tenth document, by crc32 of its id, gets a periodic tail; a null id counts as empty text."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    a = g % n
    return None if h % 10 else (a, 1 + (n - a) // (3 + g % 8))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), _planted_tail)
    found = found.withColumns({"best": periods.strongest(F.col("runs")), "lines": F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))})
    lines = F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_suffix_dedup, op3_packing, op4_chat, op5_simhash, op6_warc_merkle, op7_language_id, op8_embedding_dedup, op9_topk, op10_brown_lm, op11_source_divergence, op12_toxicity, op13_periodic_runs)}


_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(text) + CASE WHEN regexp_matches(text || ' ', '\\[\\#:<]|### ') OR contains(text, ' </turn>' || chr(10))
    THEN length(regexp_replace(text, '[^\\#<]', '', 'g')) ELSE 0 END + 4 + length(role) + 2 + 9 AS size FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

_TOPK = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.t, c.t), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_EMBED = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(u, w) AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM reach r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS m FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS k FROM l GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.u LEFT JOIN c ON e.vec_id = c.u"""


_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
vs AS (SELECT lang, count(*) AS v, sum(c) AS total FROM kept GROUP BY 1),
ns AS (SELECT lang, source, sum(c) AS total FROM n GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 1)) // (coalesce(ns.total, 0) + vs.v) AS p,
    1 + (1000000000::HUGEINT * (kept.c + 1)) // (vs.total + vs.v) AS q
  FROM g JOIN kept USING (lang) JOIN vs USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
    LEFT JOIN ns ON ns.lang = g.lang AND ns.source = g.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM k WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": _CHAT, "op8_embedding_dedup": _EMBED, "op9_topk": _TOPK, "op11_source_divergence": _DIVERGENCE}
