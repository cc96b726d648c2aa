"""The queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read
from . import encode, neardup, packing, pairs, quality, scans

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(read(spark, d, "documents"))


@query
def p7_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Container of every article, or piece of an article larger than the capacity, for each budget."""
    docs = read(spark, d, "documents")
    shards = max(1, -(-docs.select("doc_id").count() // packing.SHARD_ITEMS))
    return packing.fill_containers(encode.token_counts(docs), packing.budget_list(read(spark, d, "token_budgets")), shards)


@query
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per budget: containers, tokens, the least number of containers possible, and the share of space used."""
    caps = read(spark, d, "token_budgets").select("budget_id", F.col("capacity").cast("long").alias("capacity"))
    by = p7_assignments(spark, d).groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    return by.join(F.broadcast(caps), "budget_id").select("budget_id", "capacity", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("fill"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(read(spark, d, "eval_items"))


@query
def p1_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Defects per evaluation run and type."""
    items = read(spark, d, "eval_items").select("item_id", "run_id").distinct()
    return p1_found(spark, d).join(items, "item_id").groupBy("run_id", "defect").agg(F.countDistinct("item_id").alias("n_items"))


@query
def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(read(spark, d, "documents"), read(spark, d, "doc_kind_labels"), read(spark, d, "common_words"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_stats(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    lines = scans.scan_lines(read(spark, d, "pdf_conversions"))
    return lines.select("file_id", "line_no", F.explode("noise").alias("noise")).distinct()


@query
def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every scanned file."""
    return scans.repaired_texts(read(spark, d, "pdf_conversions"))


def _described(spark: SparkSession, d: str) -> DataFrame:
    nodes = read(spark, d, "kb_nodes").select(F.lit("kb_nodes").alias("src"), F.col("node_id").alias("key"), "text")
    docs = read(spark, d, "cleaned_docs").select(F.lit("cleaned_docs").alias("src"), F.col("record_id").cast("string").alias("key"), F.col("problem.description").alias("text"))
    return nodes.unionByName(docs)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.key_pairs(*neardup.near_duplicates(_described(spark, d)))


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: the class of its copies, its group, and the number of similar other texts."""
    return neardup.record_groups(*neardup.near_duplicates(_described(spark, d)))
