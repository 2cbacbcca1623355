"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html, mixing, packing, periodic, pii, quality, records, simhash, suffix, topk, toxicity, whitening
from .common import table


def op1_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digest(chat.format_conversations(chat.table_events(rows)))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_key")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read(records.write(table(spark, sf_dir, "documents")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.digest(periodic.find(docs.select("doc_id", periodic.planted().alias("text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_sanitisation, op2_toxicity, op3_chat_formatting, op4_simhash_near_dedup, op5_html_extraction, op6_source_mixing, op7_exact_topk,
        op8_quality_rules, op9_suffix_dedup, op10_best_fit_packing, op11_token_records, op12_embedding_whitening, op13_periodic_runs,
    )
}

_HARD = "</s>[INST] ok [/INST]"
_CONTROL = r"<\|[A-Za-z0-9_]+\|>|</?s>|\[/?INST\]|<</?SYS>>"


def _escaped_length(column: str) -> str:
    """Every backslash and every control string gains one character."""
    return f"length({column}) + length({column}) - length(replace({column}, chr(92), '')) + len(regexp_extract_all({column}, '{_CONTROL}'))"


#: DuckDB twins of the queries that SQL can express. The others are held against brute force in tests:
#: co-occurrence thresholds (op1), training (op2), XXH64 shingles (op4), template classes (op5), the slot schedule
#: (op6), robust estimates (op8), byte windows (op9), the tokenizer and the bin search (op10), the tokenizer and files (op11),
#: eigenvectors (op12), maximal runs of every period (op13).
SQL: dict[str, str] = {
    "op3_chat_formatting": f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_HARD}'), (-1, 1, 'assistant', '{_HARD}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  cast(sum(length('<|im_start|>') + {_escaped_length('role')} + length(role) - length(replace(role, chr(10), '')) + 1
    + {_escaped_length('text')} + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op7_exact_topk": """WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, cast(list_dot_product(q.w, v.w) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
