"""Operations on a node table: upsert, delete, lookups. Nothing is changed in place; each gives the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str = "node_id", order: str = "loaded_at") -> DataFrame:
    """The last row of each key by delivery time, ties by a hash of the whole row and then the row; null keys are dropped.

    An aggregate, so that repeated deliveries of a key are reduced before they are shuffled. Maps cannot be compared and
    are left out of the tie-break; rows that differ in nothing else may change places.
    """
    plain = [c for c, t in rows.dtypes if "map<" not in t]
    last = F.max_by(F.struct("*"), F.struct(order, F.xxhash64(*plain).alias("_h"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(plain)]))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(last.alias("_r")).select("_r.*")


def upsert(existing: DataFrame, batch: DataFrame, key: str = "node_id") -> DataFrame:
    """existing with the rows of a batch put in the place of those with their keys; the batch's last row of a key wins."""
    new = latest(batch, key)
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def delete(nodes: DataFrame, ref_docs: DataFrame | None = None, node_ids: DataFrame | None = None, clear: bool = False) -> DataFrame:
    """Nodes without those of given documents or ids. Without either everything goes, but only if that is asked for."""
    if ref_docs is None and node_ids is None:
        if not clear:
            raise ValueError("name documents or nodes, or ask for clear")
        return nodes.limit(0)
    for keys, name in ((ref_docs, "ref_doc_id"), (node_ids, "node_id")):
        if keys is not None:
            nodes = nodes.join(keys.select(name).distinct(), name, "left_anti")
    return nodes


def reingest(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Documents of a batch replace their former nodes as a whole."""
    return upsert(delete(nodes, batch.where("ref_doc_id is not null")), batch)


def ref_doc_info(nodes: DataFrame) -> DataFrame:
    """ref_doc_id, node_ids (sorted), n."""
    return nodes.where("ref_doc_id is not null").groupBy("ref_doc_id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"), F.countDistinct("node_id").alias("n"))


def hydrate(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Results with the text of their nodes; an id that is not there keeps an empty text."""
    return results.join(nodes.select("node_id", "text"), "node_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
