"""Measures of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

METRICS = ("hit_rate", "mrr", "precision", "recall", "ndcg", "ap")


def retrieval_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id and its measures: results (query_id, doc_id, rank) against expected (query_id, doc_id).

    One row per query with something expected; without results all measures are 0. The ideal gain has as many places as
    documents are expected.
    """
    rel = results.join(expected.select("query_id", "doc_id", F.lit(1).alias("rel")), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    seen = rel.withColumn("seen", F.sum("rel").over(W.partitionBy("query_id").orderBy("rank")))
    hit = F.col("rel") == 1
    got = seen.groupBy("query_id").agg(
        F.count("*").alias("got"), F.sum("rel").alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    want = expected.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))

    def zero(c):
        return F.round(F.coalesce(c, F.lit(0.0)), 6)

    return want.join(got, "query_id", "left").select(
        "query_id", F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("hits") / F.col("got")).alias("precision"),
        zero(F.col("hits") / F.col("n")).alias("recall"), zero(F.col("ap") / F.col("n")).alias("ap"), zero(F.col("dcg") / ideal).alias("ndcg"),
    )


def metrics_summary(items: DataFrame) -> DataFrame:
    """run_id, metric, mean, items over a map of metrics; what an item lacks counts 0.

    Metrics have four decimals; their sum is taken in whole ten-thousandths, so that it does not depend on any order.
    """
    rows = items.select("run_id", "retrieval_metrics", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    value = F.coalesce(F.try_element_at("retrieval_metrics", F.col("metric")), F.lit(0.0))
    return rows.groupBy("run_id", "metric").agg((F.sum(F.round(value * 10_000).cast("long")).cast("double") / (F.count("*") * F.lit(10_000.0))).alias("mean"), F.count("*").alias("items"))


def response_summary(items: DataFrame) -> DataFrame:
    """evaluator, avg_score, passing_rate, items over JSON objects of {evaluator: {score, passing}}."""
    parsed = F.from_json("response_metrics", "map<string,struct<score:double,passing:boolean>>")
    rows = items.select(F.explode(parsed).alias("evaluator", "v"))
    return rows.groupBy("evaluator").agg(F.round(F.avg("v.score"), 6).alias("avg_score"), F.round(F.avg(F.col("v.passing").cast("int")), 6).alias("passing_rate"), F.count("*").alias("items"))
