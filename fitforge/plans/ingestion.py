"""Registered queries on taking postings in and writing them: batches, answers of a model, addresses, payloads, commits; and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitforge import storage
from fitforge.functions import answers, resumes, urls
from fitforge.functions import text as texts
from fitforge.operators import batches
from fitforge.plans.postings import _pick, _picked
from fitforge.plans.queries import _query
from fitforge.sources import boards
from fitforge.streaming import folds, ordered

# Texts of a request, tokens a minute and the share of them that a request may take.
MOST_TEXTS, TOKENS, HEADROOM = 128, 10_000, 0.9


@_query(f"""
    WITH RECURSIVE numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, coalesce(length(text) // 3 + 1, 0) AS cost FROM documents),
    fold AS (
        SELECT 0::BIGINT AS place, cost, 1 AS n, 0::BIGINT AS batch FROM numbered WHERE place = 0
        UNION ALL
        SELECT place, CASE WHEN full_up THEN own ELSE sum END, CASE WHEN full_up THEN 1 ELSE n + 1 END, batch + CASE WHEN full_up THEN 1 ELSE 0 END
        FROM (SELECT r.place, r.cost AS own, f.cost + r.cost AS sum, f.n, f.batch, f.n >= {MOST_TEXTS} OR f.cost + r.cost > {int(TOKENS * HEADROOM)} AS full_up FROM fold f JOIN numbered r ON r.place = f.place + 1))
    SELECT doc_id, place, batch FROM fold JOIN numbered USING (place)""")
def txt23_batches(t):
    rows = t("documents").select("doc_id", texts.token_estimate("text").alias("tokens"))
    return batches.greedy_batches(rows, "doc_id", rows["tokens"], MOST_TEXTS, int(TOKENS * HEADROOM)).select("doc_id", "place", "batch")


# ---------------------------------------------------------------- answers of a language model

_KINDS = ["missing_skill", "weak_requirement", "structure", "strength", "praise"]
_MESSAGES = ["Name the tools that you have used.", "too short", "Tell what came of it, in numbers if you can."]


def _answers(t):
    """An answer for each order: broken in one of five, with too few items, wrong kinds, short messages or no strength in others."""
    k = F.col("o_orderkey")
    item = lambda i: F.struct(
        _pick(_KINDS, F.when(k % 3 == 0, i).otherwise(i % 4)).alias("type"), F.when((k % 11 == 0) & (i == 2), "grave").otherwise("low").alias("severity"), _pick(_MESSAGES, F.when(k % 7 == 0, i).otherwise(i % 2 * 2)).alias("message"), i.alias("rank")
    )
    text = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), (k % 9).cast("int") + 1), item).alias("items")))
    broken = F.when(k % 20 == 4, F.lit(None).cast("string")).when(k % 20 == 9, F.substring(text, 2, 1000)).when(k % 20 == 14, F.lit("[1, 2]")).otherwise(F.concat(F.lit("Here: "), text))
    return t("orders").select("o_orderkey", F.when(k % 5 == 4, broken).otherwise(text).alias("answer"))


_ANSWERS_SQL = f"""
    numbered AS (SELECT o_orderkey AS k, unnest(range(1, o_orderkey % 9 + 2)) AS i FROM orders),
    items AS (
        SELECT k, i, {_picked(_KINDS, 'CASE WHEN k % 3 = 0 THEN i ELSE i % 4 END')} AS type, k % 11 = 0 AND i = 2 AS grave, {_picked(_MESSAGES, 'CASE WHEN k % 7 = 0 THEN i ELSE i % 2 * 2 END')} AS message FROM numbered),
    told AS (SELECT k, i, unnest([CASE WHEN type = 'praise' THEN 'type' END, CASE WHEN grave THEN 'severity' END, CASE WHEN length(message) < 10 THEN 'message' END]) AS what, generate_subscripts([1, 2, 3], 1) AS j FROM items),
    wrong AS (SELECT k, list((i - 1) || ': ' || what ORDER BY i, j) AS errors FROM told WHERE what IS NOT NULL GROUP BY k),
    counted AS (SELECT k, count(*) AS n, bool_or(type = 'strength') AS strong FROM items GROUP BY k),
    judged AS (
        SELECT k, CASE WHEN k % 20 = 14 THEN ['no items'] WHEN k % 5 = 4 THEN ['no JSON']
                  ELSE list_concat(CASE WHEN n NOT BETWEEN 5 AND 8 THEN [n || ' items'] ELSE [] END, CASE WHEN strong THEN [] ELSE ['no strength'] END, coalesce(errors, [])) END AS errors, n
        FROM counted LEFT JOIN wrong USING (k))"""


@_query(f"WITH {_ANSWERS_SQL} SELECT k AS o_orderkey, array_to_string(errors, ', ') AS errors FROM judged")
def jsn1_answer_errors(t):
    return _answers(t).select("o_orderkey", F.array_join(answers.answer_errors(F.col("answer")), ", ").alias("errors"))


@_query(f"""
    WITH {_ANSWERS_SQL}
    SELECT k AS o_orderkey, CASE WHEN len(errors) = 0 THEN 'llm' ELSE 'template' END AS source, CASE WHEN len(errors) = 0 THEN n ELSE 1 END::INT AS n_items,
           CASE WHEN len(errors) = 0 THEN (SELECT message FROM items i WHERE i.k = judged.k AND i.i = 1) ELSE 'The text is well laid out and quick to read.' END AS first FROM judged""")
def scr12_chosen_feedback(t):
    nothing = F.array().cast("array<struct<skill:string,weight:double>>")
    templates = resumes.template_feedback(nothing, nothing, F.array().cast("array<struct<section:string,text:string>>"), F.array().cast("array<struct<label:string,detail:string>>"))
    chosen = _answers(t).select("o_orderkey", answers.chosen_feedback(F.col("answer"), templates).alias("f"))
    return chosen.select("o_orderkey", "f.source", F.size("f.items").alias("n_items"), F.get("f.items", F.lit(0))["message"].alias("first"))


# ---------------------------------------------------------------- addresses and payloads

_BOARDS = [urls.Board("a", r"(?:[\w-]+\.)+example\.com", r"/([a-z]{2})/(\d{1,20})/?"), urls.Board("b", r"(?:[\w-]+\.)+example\.(?:net|org)", r"/([a-z]{2})/(\d{1,20})/?")]


def _odd_url(c: Column, k: Column) -> Column:
    """Addresses that lead elsewhere, or nowhere, or are written in another way."""
    rest = F.regexp_replace(c, "^https?://", "")
    odd = [c, F.concat(F.lit("https://user@"), rest), F.concat(F.lit("ftp://"), rest), F.regexp_replace(c, r"(\.example\.\w+)", "$1:8080"), F.concat(F.lit("  "), F.upper(F.regexp_extract(c, "^(https?://[^/]+)", 1)), F.regexp_extract(c, "^https?://[^/]+(.*)", 1), F.lit(" "))]
    odd += [F.regexp_replace(c, r"(\.example\.\w+)", "$1.evil.test"), F.concat(F.lit("https://evil.test/"), rest), F.regexp_replace(c, r"/(\d+)", "/$1/more"), F.lit(None).cast("string"), F.regexp_replace(c, r"/(\d+)", "/$1/")]
    return F.element_at(F.array(*odd), F.pmod(k, F.lit(len(odd))).cast("int") + 1)


@_query(r"""
    WITH parts AS (SELECT page_id, url, page_id % 10 AS way, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(regexp_replace(split_part(url, '://', 2), '[?#].*', ''), '/', 2) AS token, split_part(regexp_replace(split_part(url, '://', 2), '[?#].*', ''), '/', 3) AS id,
                          len(string_split(regexp_replace(split_part(url, '://', 2), '[?#].*', ''), '/')) AS depth FROM pages),
    good AS (SELECT *, way IN (0, 4, 9) AND (depth = 3 OR (depth = 4 AND way <> 9 AND regexp_matches(regexp_replace(url, '[?#].*', ''), '/$'))) AND length(token) = 2 AND token = lower(token) AND regexp_matches(id, '^\d+$') AND regexp_matches(host, '[.]example[.](com|net|org)$') AS ok FROM parts)
    SELECT page_id, CASE WHEN ok THEN CASE WHEN host LIKE '%.com' THEN 'a' ELSE 'b' END END AS board, CASE WHEN ok THEN token END AS token, CASE WHEN ok THEN id END AS external_id FROM good""")
def src6_posting_references(t):
    found = t("pages").select("page_id", urls.posting_reference(_odd_url(F.col("url"), F.col("page_id")), _BOARDS).alias("r"))
    return found.select("page_id", "r.board", "r.token", "r.external_id")


_PAYLOAD = "id bigint, title string, place struct<name: string>"


def _payloads(t):
    k = F.col("o_orderkey")
    good = F.to_json(F.struct(k.alias("id"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("title"), F.struct(F.lit("Rome").alias("name")).alias("place")))
    odd = F.when(k % 6 == 1, F.concat(F.lit("{"), good)).when(k % 6 == 2, F.lit(" ")).when(k % 6 == 3, F.regexp_replace(good, r'"id":\d+', '"id":"x"')).when(k % 6 == 4, F.lit(None).cast("string"))
    return t("orders").select("o_orderkey", F.when((k % 6).isin(1, 2, 3, 4), odd).otherwise(good).alias("payload"))


@_query("""
    SELECT o_orderkey, w IN (0, 5) AND o_orderkey % 7 <> 0 AS accepted, CASE WHEN w IN (1, 3) THEN 'malformed' WHEN w IN (2, 4) THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'without title' END AS reason
    FROM (SELECT *, o_orderkey % 6 AS w FROM orders)""")
def src1_judged_payloads(t):
    accepted, rejected = boards.judged_payloads(_payloads(t), "o_orderkey", "payload", _PAYLOAD, ["id", "title"])
    return accepted.select("o_orderkey", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("o_orderkey", F.lit(False).alias("accepted"), "reason"))


# ---------------------------------------------------------------- writing

_CHUNKS = 4


@_query(f"SELECT o_orderkey, o_custkey, (o_custkey % {_CHUNKS})::INT AS chunk FROM orders")
def snk1_committed_chunks(t):
    """The postings as read back from a table that took them in labelled chunks, one commit each, the first of them twice."""
    rows = t("orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % _CHUNKS).cast("int").alias("chunk"))
    table = storage.SnapshotTable(rows.sparkSession, storage.new_folder(rows.sparkSession, "postings"))
    chunks = [(f"chunk {c}", rows.where(F.col("chunk") == c)) for c in (0, *range(_CHUNKS))]
    storage.commit_chunks(table, chunks)
    return table.read(rows.schema)


@_query("""
    SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
    WHERE NOT (o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey % 3 = 0)""")
def dml11_rewritten_partitions(t):
    """Deletes of some owners in two priorities, as a rewrite of these two partitions of a written table."""
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    spark, path = rows.sparkSession, storage.new_folder(rows.sparkSession, "orders")
    rows.repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    gone = stored.where("o_orderpriority in ('1-URGENT', '5-LOW') and o_custkey % 3 = 0")
    storage.rewrite_partitions(stored, path, "o_orderpriority", gone, lambda old: old.where("o_custkey % 3 <> 0 or o_custkey is null"))
    return spark.read.schema(rows.schema).parquet(path)


@_query()
def win10_paced_requests(t):
    """When each client's requests go out under limits of three requests and 150 units an hour: every event is a request that costs its value."""
    e = t("events").select("event_id", "user_id", "ts", F.ceil("value").cast("long").alias("tokens"))
    sent = ordered.in_order(e, "user_id", "ts", folds.paced("tokens", "event_id", 3, 150, 3600))
    return sent.select("event_id", "user_id", "tokens", "sent")
