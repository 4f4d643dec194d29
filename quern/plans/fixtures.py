"""Views of the provided tables in the shape of the engine's records, as DataFrames and as SQL for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import read_table


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("qid"), (F.row_number().over(w) - 1).alias("sample_idx"), (F.col("l_returnflag") == "R").alias("correct"),
        F.when(F.col("l_linestatus") == "F", "stop").otherwise("length").alias("finish_reason"), F.col("l_quantity").cast("int").alias("n_tokens"), F.col("l_returnflag").alias("extracted"),
    )


R = """r AS (SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS sample_idx,
 l_returnflag = 'R' AS correct, CASE WHEN l_linestatus = 'F' THEN 'stop' ELSE 'length' END AS finish_reason, l_quantity::INT AS n_tokens, l_returnflag AS extracted FROM lineitem)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Rollouts without a number: the same counts without a window."""
    li = read_table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("qid"), (F.col("l_returnflag") == "R").alias("correct"), F.when(F.col("l_linestatus") == "F", "stop").otherwise("length").alias("finish_reason"), F.col("l_quantity").cast("int").alias("n_tokens"), F.col("l_returnflag").alias("extracted"))


S = """s AS (SELECT l_orderkey AS qid, l_returnflag = 'R' AS correct, CASE WHEN l_linestatus = 'F' THEN 'stop' ELSE 'length' END AS finish_reason, l_quantity::INT AS n_tokens, l_returnflag AS extracted FROM lineitem),
q AS (SELECT qid, count(*) AS n, count(*) FILTER (WHERE correct AND finish_reason <> 'length') AS c, count(*) FILTER (WHERE correct) AS c_raw, count(*) FILTER (WHERE finish_reason = 'length') AS n_truncated FROM s GROUP BY qid)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("qid"), F.col("o_orderstatus").alias("final_answer"), F.col("o_orderpriority").alias("domain"), "o_custkey")


def candidates(spark: SparkSession, d: str, qid: str = "lang") -> DataFrame:
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(F.col(qid).alias("qid"), F.col("doc_id").alias("attempt_idx"), F.col("text").alias("continuation_text"), (F.col("quality") == 1).alias("correct"), F.when(F.col("toxic") == 1, "toxic").alias("external_context"), F.col("n_chars").alias("n_total"))


def C(qid: str = "lang") -> str:
    return f"c AS (SELECT {qid} AS qid, doc_id AS attempt_idx, text AS continuation_text, quality = 1 AS correct, CASE WHEN toxic = 1 THEN 'toxic' END AS external_context, n_chars AS n_total FROM documents LEFT JOIN labels USING (doc_id))"


def logprobs(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.select(F.col("label").cast("bigint").alias("qid"), F.col("vec_id").alias("attempt_idx"), F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("token_logprobs"))


L = "l AS (SELECT label::BIGINT AS qid, vec_id AS attempt_idx, list_transform(embedding, lambda x: -abs(x::DOUBLE)) AS token_logprobs FROM embeddings)"


def alphas(spark: SparkSession, d: str) -> DataFrame:
    """Events as graded samples at an alpha, by type."""
    e = read_table(spark, d, "events")
    return e.select(F.col("user_id").alias("qid"), ((F.pmod(F.length("event_type"), F.lit(5)) + 1) / 5.0).alias("alpha"), (F.col("value") > 50).alias("correct"))


A = "a AS (SELECT user_id AS qid, (length(event_type) % 5 + 1) / 5.0::DOUBLE AS alpha, value > 50 AS correct FROM events), p AS (SELECT qid, alpha, count(*) FILTER (WHERE correct) / count(*)::DOUBLE AS p_hat FROM a GROUP BY ALL)"
