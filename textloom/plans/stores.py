"""Queries of the node store. The batch is what was loaded since June 2025, the store what was there before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store as S
from ..session import read

QUERIES = {}
SQL = {}
CUT = "timestamp_ntz '2025-06-01 00:00:00'"


def query(f):
    QUERIES[f.__name__] = f
    return f


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "kb_nodes").select("node_id", "ref_doc_id", "text", "loaded_at", "deleted_at")


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = nodes(spark, d)
    return S.latest(n.where(f"loaded_at < {CUT}")), n.where(f"loaded_at >= {CUT}")


def shown(df: DataFrame) -> DataFrame:
    return df.select("node_id", "ref_doc_id", F.length("text").alias("chars"), F.col("deleted_at").isNotNull().alias("deleted"))


_LATEST = "(select * from (select node_id, ref_doc_id, text, loaded_at, deleted_at, row_number() over (partition by node_id order by loaded_at desc) n from kb_nodes where node_id is not null and {0}) where n = 1)"
_OLD, _NEW = _LATEST.format("loaded_at < timestamp '2025-06-01'"), _LATEST.format("loaded_at >= timestamp '2025-06-01'")
_SHOWN = "node_id, ref_doc_id, length(text)::int chars, deleted_at is not null deleted"


@query
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.upsert(*parts(spark, d)))


SQL["store_upsert"] = f"select {_SHOWN} from (select * from {_OLD} where node_id not in (select node_id from {_NEW}) union all select * from {_NEW})"


@query
def store_delete(spark: SparkSession, d: str) -> DataFrame:
    """The store without the nodes of documents that some row of kb_docs says are deleted."""
    gone = read(spark, d, "kb_docs").where("deleted_at is not null and ref_doc_id is not null").select("ref_doc_id")
    return shown(S.delete(parts(spark, d)[0], gone))


SQL["store_delete"] = f"select {_SHOWN} from {_OLD} where ref_doc_id is null or ref_doc_id not in (select ref_doc_id from kb_docs where deleted_at is not null and ref_doc_id is not null)"


@query
def store_reingest(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.reingest(*parts(spark, d)))


SQL["store_reingest"] = f"select {_SHOWN} from (select * from {_OLD} where (ref_doc_id is null or ref_doc_id not in (select ref_doc_id from kb_nodes where loaded_at >= timestamp '2025-06-01' and ref_doc_id is not null)) and node_id not in (select node_id from {_NEW}) union all select * from {_NEW})"


@query
def store_refdoc(spark: SparkSession, d: str) -> DataFrame:
    return S.ref_doc_info(nodes(spark, d))


SQL["store_refdoc"] = "select ref_doc_id, list_sort(list_distinct(list(node_id))) node_ids, count(distinct node_id) n from kb_nodes where ref_doc_id is not null group by 1"


@query
def store_hydrate(spark: SparkSession, d: str) -> DataFrame:
    """Node ids that documents list, with the length of the node's text; ids that no node has keep an empty text."""
    ids = read(spark, d, "kb_docs").select(F.explode(F.from_json("node_ids", "array<string>")).alias("node_id")).where("node_id is not null").distinct()
    return S.hydrate(ids, S.latest(nodes(spark, d))).select("node_id", F.length("text").alias("chars"))


SQL["store_hydrate"] = f"select node_id, length(coalesce(text, ''))::int chars from (select distinct unnest(from_json(node_ids, '[\"VARCHAR\"]')) node_id from kb_docs) left join {_LATEST.format('true')} using (node_id) where node_id is not null"
