"""The operators of this subpackage over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, language, mixing, near, packing, quality, rans, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encode_corpus(_table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rendering's digest, its length, and its spans as text."""
    shown = chat.rotate(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return shown.select("conv_id", "perspective", "part", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"), spans.alias("spans"), "n_turns", "n_own")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.transform("copies", lambda c: c["shard"]).alias("shards"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(_table(spark, sf_dir, "documents")).withColumnRenamed("text_digest", "text_sha256")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(toxicity.sample(docs, _table(spark, sf_dir, "labels")))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("worst.start").alias("worst_start"), F.col("worst.end").alias("worst_end"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rans_ids": op1_rans_ids,
    "op2_order_minhash": op2_order_minhash,
    "op3_chat_perspectives": op3_chat_perspectives,
    "op4_mix_sources": op4_mix_sources,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_quality_ratio": op7_quality_ratio,
    "op8_toxicity": op8_toxicity,
    "op9_pack": op9_pack,
    "op10_language": op10_language,
}

#: Base 32 by SQL: five hexadecimal digits are four characters.
_BASE32 = "array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(concat('0x', substr(h, CAST(5 * i + 1 AS INTEGER), 5)) AS BIGINT) >> k) & 31 AS INTEGER) + 1, 1)), '')), '')"

#: DuckDB SQL where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op3_chat_perspectives": """
        WITH t AS (SELECT conv_id, CAST(floor(turn / 256) AS BIGINT) AS part, turn, coalesce(role, 'unknown') AS role, coalesce(replace(text, '<|', '< |'), '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
        r AS (SELECT t.conv_id, perspective, part, turn, role, text, role = perspective AS own, concat(text, '<|end|>', chr(10)) AS body,
                     concat(CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE concat('<|user name=', replace(role, '<|', '< |'), '|>') END, chr(10)) AS head
              FROM t JOIN s ON t.conv_id = s.conv_id),
        o AS (SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM r)
        SELECT conv_id, perspective, part, md5(string_agg(concat(head, body), '' ORDER BY turn, role, text)) AS text_md5, CAST(max(stop) AS BIGINT) AS n_chars,
               coalesce(string_agg(CASE WHEN own THEN concat(stop - length(body), '-', stop) END, ',' ORDER BY stop), '') AS spans, count(*) AS n_turns, count(CASE WHEN own THEN 1 END) AS n_own
        FROM o GROUP BY conv_id, perspective, part""",
    "op6_warc": f"""
        SELECT page_id, octet_length(encode(html)) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))""",
}
