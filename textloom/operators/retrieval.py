"""Ranked retrieval for whole tables of queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import tokens
from ..session import shuffle_width, spread, staged

#: Rows of a block of queries and of a block of items in dense search; a task holds one of each.
QUERY_BLOCK, ITEM_BLOCK = 2_000, 20_000
#: Distinct terms of queries that are broadcast; more are joined.
SENT_TERMS = 200_000


def top_k(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The k best rows of each query by score, ties by item id; ranks from 1."""
    w = W.partitionBy(by).orderBy(F.desc("score"), F.asc(item))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf of every text; null and empty texts have no terms."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by id; only those are sorted."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, only: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank. queries: query_id, query_text; docs: doc_id, text, ids unique; both ids of simple types.

    Terms of a query count once. Only postings of terms that some query uses are counted and staged; the texts themselves
    never move. Queries and texts are then cut into blocks of bounded size as in dense search: each pair of blocks is one task
    that adds up the weights of its postings and keeps its k best per query, so that a term that all texts hold brings no join
    rows. With `only` (doc_id) just those texts are ranked, by the statistics of all. Queries and texts without terms match nothing.
    """
    spark = docs.sparkSession
    kind_q, kind_d = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]
    wanted = staged(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term")).distinct(), "wanted")
    sized = spread(docs.select("doc_id", "text")).select("doc_id", tokens(F.col("text")).alias("t")).withColumn("dl", F.coalesce(F.size("t"), F.lit(0)))
    # A text without terms keeps one row with a null term, so that texts and lengths are counted from the same table.
    used = wanted.select("term").distinct().withColumn("used", F.lit(True))
    used = F.broadcast(used) if used.count() <= SENT_TERMS else used
    every = sized.select("doc_id", "dl", F.explode_outer("t").alias("term")).join(used, "term", "left")
    counted = staged(every.groupBy("doc_id", "dl", F.when(F.col("used"), F.col("term")).alias("term")).agg(F.count("*").alias("tf")), "postings")
    lengths = counted.groupBy("doc_id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = lengths["n"] or 0, lengths["avgdl"] or 1.0
    tf = counted.where("term is not null")
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    if only is not None:
        tf = tf.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    weighted = tf.join(idf, "term").select("doc_id", "term", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))).alias("w"))
    nq, nd = blocks(wanted.select("query_id").distinct().count(), QUERY_BLOCK), max(blocks(n, ITEM_BLOCK), min(shuffle_width(spark), blocks(n, ITEM_BLOCK // 20)))
    q = wanted.withColumn("i", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
    d = weighted.withColumn("j", F.pmod(F.xxhash64("doc_id"), F.lit(nd)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        term, names = pd.factorize(held["term"])
        doc, ids = pd.factorize(held["doc_id"], sort=True)
        order = np.argsort(term, kind="stable")
        doc, w, begin = doc[order], held["w"].to_numpy()[order], np.searchsorted(term[order], np.arange(len(names) + 1))
        place = pd.Index(names).get_indexer(asked["term"])
        out = []
        for name, at in asked.groupby("query_id", sort=False).indices.items():
            parts = [slice(begin[t], begin[t + 1]) for t in place[at] if t >= 0]
            if parts:
                total = np.round(np.bincount(np.concatenate([doc[p] for p in parts]), np.concatenate([w[p] for p in parts]), len(ids)), 6)
                top = best_of(total, np.arange(len(ids)), k)
                top = top[total[top] > 0]
                out.append(pd.DataFrame({"query_id": [name] * len(top), "doc_id": np.asarray(ids)[top], "score": total[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

    best = q.groupBy("i", "j").cogroup(d.groupBy("i", "j")).applyInPandas(score, f"query_id {kind_q}, doc_id {kind_d}, score double")
    return top_k(best, k)


def blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def dense_topk(queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, doc_id, score, rank by cosine, dot product or (negative) Euclidean distance.

    queries: query_id, embedding; items: doc_id, embedding. Both are cut into blocks of bounded size; each pair of
    blocks is one task that keeps its k best per query, so no side is ever whole in a task or broadcast. Null and empty
    vectors match nothing; a zero vector has cosine 0.
    """
    kind_q, kind_d = dict(queries.dtypes)["query_id"], dict(items.dtypes)["doc_id"]
    q = queries.where("size(embedding) > 0").select("query_id", "embedding")
    d = items.where("size(embedding) > 0").select("doc_id", "embedding")
    nq, nd = blocks(q.count(), QUERY_BLOCK), blocks(d.count(), ITEM_BLOCK)
    q = q.withColumn("i", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
    d = d.withColumn("j", F.pmod(F.xxhash64("doc_id"), F.lit(nd)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        if a.empty or b.empty:
            return empty
        x, y = np.stack(a["embedding"].to_numpy()).astype(float), np.stack(b["embedding"].to_numpy()).astype(float)
        if metric == "l2":
            s = -np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))
        else:
            if metric == "cosine":
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
            s = x @ y.T
        s = np.round(s, 6) + 0.0
        ids = b["doc_id"].to_numpy()
        order = np.stack([best_of(row, ids, k) for row in s])
        return pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), order.shape[1]), "doc_id": ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    best = q.groupBy("i", "j").cogroup(d.groupBy("i", "j")).applyInPandas(score, f"query_id {kind_q}, doc_id {kind_d}, score double")
    return top_k(best, k)


def rrf(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, rank): sum of 1 / (constant + rank)."""
    every = None
    for ranked in lists:
        part = ranked.select("query_id", "doc_id", (1.0 / (constant + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    return top_k(every.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score")), k)


def min_max(ranked: DataFrame, name: str) -> DataFrame:
    """Scores scaled to 0..1 within each query; 1 where all are equal."""
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranked.select("query_id", "doc_id", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)).alias(name))


def weighted_fusion(dense: DataFrame, sparse: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """alpha times the scaled dense score plus (1 - alpha) times the scaled sparse one; a missing side counts 0."""
    both = min_max(dense, "d").join(min_max(sparse, "s"), ["query_id", "doc_id"], "full")
    score = F.round(alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0)), 6)
    return top_k(both.select("query_id", "doc_id", score.alias("score")), k)


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; nothing is chosen by chance if the order is total."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def overlap_score(query: Column, text: Column) -> Column:
    """Jaccard similarity of the words of two texts; 0 if both have none."""
    a, b = F.array_distinct(tokens(F.coalesce(query, F.lit("")))), F.array_distinct(tokens(F.coalesce(text, F.lit(""))))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / union, 6))


def filter_results(rows: DataFrame, source: str | None, low: float, high: float | None, k: int) -> DataFrame:
    """Rows of each query within score bounds whose source holds a text, whatever its case; the best k."""
    keep = F.col("score") >= low
    if high is not None:
        keep &= F.col("score") <= high
    if source:
        keep &= F.contains(F.lower("source"), F.lit(source.lower()))
    return top_k(rows.where(keep), k)
