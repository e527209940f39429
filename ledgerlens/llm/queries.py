"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them.

Each query applies its operator, with its production parameters, to the whole intended table and
derives the contract's columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, exact_dedup, fingerprints, hard_negatives, license_scan, line_dedup, packing, resampling, simhash_dedup,
               tool_calls, topk, toxicity, warc)
from .tables import stage, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return add


def unsigned_hex(col: str) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.col(col))), 16, "0")


@register("op1_license_scan")
def license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    return out.withColumn("n_notices", F.size("notices").cast("long")).drop("notices")


@register("op2_warc")
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op3_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048)


@register("op4_tool_calls")
def tool_calls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tool_calls.link(*tool_calls.calls_of(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "call_id", "turn", "wave", "status", "name", "valid",
                      F.array_join("problems", "; ").alias("problems"), "n_results",
                      F.sha2("canonical", 256).alias("canonical_sha256"))


@register("op5_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return out.select("doc_id", unsigned_hex("fp").alias("fingerprint"), "component_id")


@register("op6_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW best AS (PARTITION BY norm ORDER BY n DESC, doc_id)
""")
def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@register("op7_bpe")
def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op8_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op9_fingerprints")
def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compare_with_next(table(spark, sf_dir, "documents"))
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    out = fingerprints.count_neighbours(stage(rows, "fingerprint-rows"), asked, radius=3, blocks=5)
    return out.select("doc_id", "n_chars", "edited_sha256", unsigned_hex("fp").alias("fingerprint"),
                      unsigned_hex("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")


@register("op10_line_dedup")
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"), k=2, min_chars=20, equal_chars=1)
    return out.select("doc_id", "line_report.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_WHOLE = """
SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)) AS v{more} FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""


@register("op11_topk", f"""
WITH e AS ({_WHOLE.format(factor=64, more="")}),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
          FROM e q, e c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20, factor=64)


@register("op12_hard_negatives", f"""
WITH e AS ({_WHOLE.format(factor=256, more=", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")}
           AND label IS NOT NULL),
pairs AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
          FROM e a, e c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
                  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
           FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
            AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT * FROM ranked WHERE rank <= 10
""")
def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5,
                               negatives=10, low=30, high=90, factor=256)


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


@register("op13_resampling", f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
held AS (SELECT r, unnest(words) AS w FROM docs), wanted AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM held UNION ALL SELECT w FROM wanted)),
bytes AS (SELECT w, list_transform(range(1, octet_length(encode(w)) + 1),
                                   lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT) AS bytes FROM vocabulary),
buckets AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, byte: list_reduce(
                     list_prepend(xor(crc, byte), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))),
                   4294967295::BIGINT) % 10000 AS b FROM bytes),
s AS (SELECT b, count(*) AS n FROM held JOIN buckets USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM wanted JOIN buckets USING (w) GROUP BY b),
gains AS (SELECT u.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + 10000 FROM s)::DOUBLE
                 / ((coalesce(s.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + 10000 FROM t)::DOUBLE))) AS gain
          FROM (SELECT unnest(range(10000)) AS b) u LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weights AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight
            FROM held JOIN buckets USING (w) JOIN gains USING (b) GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
           FROM docs LEFT JOIN weights USING (r)),
placed AS (SELECT *, n_features >= 20 AND score IS NOT NULL AS able, row_number() OVER (
               PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN able AND place <= (SELECT count(*) FROM placed WHERE able) * 10 // 100 THEN place END AS rank
FROM placed
""")
def resampling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), per_cent=10,
                               least_words=20, buckets=10000, longest=1, seed=2024)
