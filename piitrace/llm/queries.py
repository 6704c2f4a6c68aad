"""The registered queries of this subpackage and, where SQL can say it, their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piitrace.llm import (
    ann,
    bpe_trie,
    conversation_repair,
    hard_negatives,
    jaccard_join,
    langid,
    lattice_lm,
    licenses,
    line_dedup,
    packing,
    token_counts,
    token_files,
    vector_dedup,
)
from piitrace.session import scratch

Query = Callable[[SparkSession, str], DataFrame]
c = F.col


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset", "sequence_length")


def op2_collision_search(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), c("vec_id") % 20 == 0)


def op3_bpe_trie(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_trie.encode(table(spark, folder, "documents"), vocabulary, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", c("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def _rest(key: str, n: int) -> F.Column:
    """crc32 of a key written out, modulo n; null for a null key."""
    return F.crc32(c(key).cast("string").cast("binary")) % n


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn(
        "held_out", F.coalesce(_rest("doc_id", 4) == 2, F.lit(False)))
    model = langid.fit(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op5_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, folder, "embeddings"))


#: All pairs of vectors, and everything a chain of links reaches.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id,
       r.vec_id = min(other) AS kept
FROM reach r LEFT JOIN counted ON a = r.vec_id GROUP BY r.vec_id
"""


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.groups(table(spark, folder, "documents"))


#: All pairs of documents by their shingles, and everything a chain of links reaches.
OP6_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
starts AS (
  SELECT doc_id, w, unnest(range(1, CASE len(w) WHEN 0 THEN 1 ELSE greatest(len(w) - 3, 2) END)) AS i
  FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id
"""


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write(table(spark, folder, "documents"), path,
                      public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_removed", "text")


def op9_lattice(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn(
        "train", F.coalesce(_rest("doc_id", 7) != 2, F.lit(True)))
    scored = lattice_lm.score(docs, public_tokenizers.path("piece_bpe_32k.model"), "train")
    return scored.select("doc_id", F.coalesce(_rest("doc_id", 7) == 2, F.lit(False)).alias("held_out"),
                         "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.find(table(spark, folder, "documents"))
    listed = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    spans = F.transform("spans", lambda s: s["label"])
    best = F.array_max(F.transform("spans", lambda s: s["coverage"]))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", listed(c("base")).alias("base_labels"),
        listed(F.concat("base", spans)).alias("labels"),
        F.when(c("n_base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.when(c("vec_id") % 7 == 0, (c("label") + 1) % 10).otherwise(c("label"))
    return hard_negatives.mine(rows.withColumn("label", label), c("vec_id") % 100 == 0)


#: All products of anchors with rows, as doubles that hold them exactly.
OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_dot_product(a.e, b.e)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same
WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count(table(spark, folder, "documents"),
                                 public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (c("n_tokens") > 2048).alias("over_limit"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversation_repair.report(rows, conversation_repair.damage(rows))


#: Row by row: for each state the least ``cost || audit`` as text, costs padded to nine digits.
OP13_SQL = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
summed AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, y: CASE WHEN x & 1 = 1
      THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM keyed),
changed AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM summed),
ordered AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text
      ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, E' \t\n\x0b\x0c\r') AS body
  FROM changed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
marked AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS r,
         lag(CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END) OVER (
           PARTITION BY conv_id ORDER BY i) AS before
  FROM ordered),
counted AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id),
walk(conv_id, i, n, q0, q1, q2, q3) AS (
  SELECT conv_id, 0, n, '000000000', '900000000', '900000000', '900000000' FROM counted
  UNION ALL
  SELECT w.conv_id, w.i + 1, n,
    add_(p0, 3, 'D'),
    CASE WHEN keep AND r = 's' THEN least(add_(p1, 3, 'D'), add_(p0, cut, 'K')) ELSE add_(p1, 3, 'D') END,
    CASE WHEN keep THEN least(add_(p2, 3, 'D'), add_(least(p0, p1, p3), CASE WHEN r = 'u' THEN cut ELSE cut + 2 END,
                                                     CASE WHEN r = 'u' THEN 'K' ELSE 'R' END))
      ELSE add_(p2, 3, 'D') END,
    CASE WHEN keep THEN least(add_(p3, 3, 'D'), add_(p2, CASE WHEN r = 'a' THEN cut ELSE cut + 2 END,
                                                     CASE WHEN r = 'a' THEN 'K' ELSE 'R' END))
      ELSE add_(p3, 3, 'D') END
  FROM (SELECT conv_id, i, n, q0 AS p0, q1 AS p1,
               least(q2, add_(q0, 2, 'I'), add_(q1, 2, 'I'), add_(q3, 2, 'I')) AS p2,
               least(q3, add_(q2, 2, 'I'), add_(q0, 4, 'II'), add_(q1, 4, 'II')) AS p3 FROM walk) w
  JOIN (SELECT conv_id, i, r, fault IN ('', 'truncated') AS keep, (fault = 'truncated')::INT AS cut FROM marked) m
    ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1),
best AS (
  SELECT conv_id, least(q0, q3, add_(q2, 2, 'I'), add_(q1, 4, 'II'), add_(q0, 4, 'II')) AS b FROM walk WHERE i = n),
edits AS (
  SELECT conv_id, len(b[10:]) - len(replace(b[10:], 'D', '')) AS gone, len(b) - 9 AS size,
         unnest(range(1, len(b) - 8)) AS j, b[10:] AS audit FROM best),
placed AS (
  SELECT conv_id, j, audit[j] AS edit, len(replace(audit[:j], 'I', '')) AS i,
         len(replace(audit[:j], 'D', '')) - 1 - (size - gone) % 2 AS place FROM edits WHERE audit[j] <> 'D'),
written AS (
  SELECT p.conv_id, string_agg(
    CASE WHEN edit = 'K' THEN m.role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN edit = 'I' THEN '' ELSE m.text END, E'\n' ORDER BY j) AS body
  FROM placed p LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i AND edit <> 'I'
  GROUP BY p.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b[:9]::BIGINT, 0) AS cost, coalesce(b[10:], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""
# One cost and edit more, written out: the SQL has no macros of its own to call.
OP13_SQL = re.sub(r"add_\((\w+|least\([^()]*\)), (\d|CASE [^()]*? END|cut),\s+('\w+'|CASE [^()]*? END)\)",
                  r"lpad(((\1)[:9]::INT + \2)::VARCHAR, 9, '0') || (\1)[10:] || \3", OP13_SQL)


QUERIES: dict[str, Query] = {
    "op1_pack": op1_pack,
    "op2_collision_search": op2_collision_search,
    "op3_bpe_trie": op3_bpe_trie,
    "op4_language": op4_language,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_files": op7_token_files,
    "op8_line_dedup": op8_line_dedup,
    "op9_lattice": op9_lattice,
    "op10_licenses": op10_licenses,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op5_vector_dedup": OP5_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_conversation_repair": OP13_SQL,
}
