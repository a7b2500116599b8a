"""Registered queries of the subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitforge.llm import bpe, exactdup, filteraudit, isolation, mixing, ngramjoin, packing, privacy, resampling, sharding, suffixes, targetsampling, toolcalls

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of ``spark.fitforge.surrogateKey``; without it one that everybody knows, for synthetic tables only."""
    return spark.conf.get("spark.fitforge.surrogateKey", "key of the synthetic tables").encode()


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def _turns_as_calls(turns: DataFrame) -> DataFrame:
    """Messages with tool calls, as the given turns have none.

    A user's turn becomes an assistant's call of ``reply`` by the name of the turn, which
    needs the replies to the two turns before; an assistant's turn becomes the tool's
    result of the turn before.
    """
    name = lambda back: F.concat(F.lit("turn-"), (F.col("turn") - back).cast("string"))
    text = F.coalesce("text", F.lit(""))
    call = F.struct(name(0).alias("id"), F.lit("reply").alias("name"), F.struct(text.alias("text")).alias("arguments"), F.array(name(1), name(2)).alias("after"))
    made = F.when(F.col("role") == "user", F.to_json(F.struct(F.array(call).alias("tool_calls"))))
    made = made.when(F.col("role") == "assistant", F.to_json(F.struct(name(1).alias("tool_call_id"), text.alias("content"))))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool")
    return turns.select("conv_id", "turn", role.alias("role"), made.alias("text")).where("role is not null")


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link_tool_calls(_turns_as_calls(_table(spark, sf_dir, "conversations")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_components(_table(spark, sf_dir, "documents"))


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(_table(spark, sf_dir, "documents"))


def op8_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(_table(spark, sf_dir, "documents"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.replace_entities(_table(spark, sf_dir, "documents"), surrogate_key(spark)).select("doc_id", "n_entities", "text")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op13_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targetsampling.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_importance_resampling,
        op2_best_fit_packing,
        op3_bpe_round_trip,
        op4_tool_call_linking,
        op5_exact_dedup,
        op6_ngram_jaccard_join,
        op7_byte_shards,
        op8_isolation_rules,
        op9_suffix_dedup,
        op10_surrogates,
        op11_filter_audit,
        op12_source_mixing,
        op13_target_sampling,
    )
}

SQL: dict[str, str] = {
    "op4_tool_call_linking": """
        WITH called AS (
            SELECT conv_id, turn, min(coalesce(text, '')) AS text, count(*) AS n_calls
            FROM conversations WHERE role = 'user' GROUP BY ALL),
        runs AS (
            SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS run
            FROM (SELECT *, CASE WHEN turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) <= 2 THEN 0 ELSE 1 END AS starts FROM called)),
        calls AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS level FROM runs),
        results AS (
            SELECT conv_id, turn, min(coalesce(text, '')) AS text, count(*) AS n_results
            FROM conversations WHERE role = 'assistant' GROUP BY ALL)
        SELECT coalesce(c.conv_id, r.conv_id) AS conv_id,
               'turn-' || coalesce(c.turn, r.turn - 1) AS call_id,
               c.turn::BIGINT AS call_turn, r.turn::BIGINT AS result_turn,
               coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
               c.level::BIGINT AS level,
               c.turn IS NOT NULL AND length(c.text) BETWEEN 1 AND 300 AS valid,
               '{"arguments":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE '{"text":' || to_json(c.text)::VARCHAR || '}' END
               || ',"id":"turn-' || coalesce(c.turn, r.turn - 1) || '","name":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE '"reply"' END
               || ',"result":' || CASE WHEN r.turn IS NULL THEN 'null' ELSE to_json(r.text)::VARCHAR END || '}' AS exchange
        FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND r.turn = c.turn + 1""",
    "op5_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
            FROM documents),
        ranked AS (
            SELECT doc_id, content,
                   first_value(doc_id) OVER (PARTITION BY content ORDER BY length(text) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY content) AS group_size
            FROM rows)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
        FROM ranked""",
    # walks every order document by document, instead of tabulating coalitions
    "op11_filter_audit": r"""
        WITH RECURSIVE letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
        orders AS (
            SELECT '' AS filter_order
            UNION ALL
            SELECT filter_order || letter FROM orders JOIN letters ON NOT contains(filter_order, letter)),
        texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        measured AS (
            SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                   length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
                   doc_id > min(doc_id) OVER (PARTITION BY text) AS copied
            FROM texts),
        failing AS (
            SELECT doc_id, part,
                   CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * capitals > 2 * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN copied THEN 'E' ELSE '' END AS fails
            FROM measured),
        marked AS (
            SELECT part, fails, count(*) AS n,
                   count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
                   count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
            FROM failing GROUP BY ALL),
        steps AS (
            SELECT filter_order, step, filter_order[step] AS letter, filter_order[:step - 1] AS earlier
            FROM orders, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
        judged AS (
            SELECT *, contains(fails, letter) AS fails_this,
                   earlier <> '' AND fails <> '' AND regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN '-' ELSE earlier END || ']') AS gone
            FROM marked, steps),
        counted AS (
            SELECT part, filter_order, step, letter,
                   coalesce(sum(n) FILTER (NOT gone AND NOT fails_this), 0) AS kept,
                   coalesce(sum(n) FILTER (NOT gone AND fails_this), 0) AS removed,
                   coalesce(sum(n) FILTER (gone AND fails_this), 0) AS redundant,
                   coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (NOT gone AND fails_this), 0) AS good_lost,
                   coalesce(sum(toxic) FILTER (NOT gone AND fails_this), 0) AS toxic_lost
            FROM judged GROUP BY ALL)
        SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM counted""",
}
