"""Contexts, prompts and conversations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ranks import numbered_within
from .extraction import asks_back


def within_budget(results: DataFrame, budget: int, dressed: bool, keep_empty: bool = False) -> DataFrame:
    """query_id, context, used: texts in order of rank as long as all of them fit the budget of characters.

    The first that does not fit ends the context, even if later ones would fit. Dressed texts are numbered and count
    with their number and the blank line between them. A query whose first text does not fit has no row, or with keep_empty
    an empty context.
    """
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text")) if dressed else F.col("text")
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    sized = results.withColumn("piece", piece).withColumn("size", F.length("piece") + (2 if dressed else 0)).withColumn("total", F.sum("size").over(w))
    fits = F.col("total") <= budget
    ordered = F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("rank", "piece")))), lambda x: x["piece"])
    contexts = sized.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("context"), F.count(F.when(fits, 1)).alias("used"))
    return contexts if keep_empty else contexts.where("used > 0")


# Prompt templates by style.
PROMPTS = {
    "compact": "Context:\n{context_str}\n\nQuestion: {query_str}\nAnswer based on the context above:",
    "refine": "We have an existing answer to the question:\n{existing_answer}\n\nWe have the opportunity to refine this answer (only if needed) with some more context below.\n\nContext:\n{context_msg}\n\nQuestion: {query_str}\n\nGiven the new context, refine the original answer to better answer the question.\nIf the context is not helpful, output the same original answer.\nRefined Answer:",
}


def prompt(style: str, **values: Column) -> Column:
    """A template with its places filled; values are not searched for places again."""
    parts = re.split(r"\{(\w+)\}", PROMPTS[style])
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def turns(items: DataFrame, conversation: str, item: str, span: int = 10_000) -> DataFrame:
    """items with turn, counted from 1 in each conversation by item number; the numbering is spread over spans of numbers."""
    return numbered_within(items, conversation, F.floor(F.col(item) / span), [item], "turn")


def enriched(rows: DataFrame, conversation: str, recent: int = 2, cut: int = 200) -> DataFrame:
    """conversation, turn, enriched: each question with the last turns before it; the first stays as it is.

    Former turns are joined by conversation and turn number, so a long conversation is no task of its own.
    """
    # The labels of questions, answers and contexts.
    said = rows.select(F.col(conversation).alias("_c"), "turn", F.concat(F.lit("问: "), "query", F.lit("\n答: "), F.substring("response", 1, cut)).alias("_said"))
    out = rows.select(conversation, "turn", "query")
    for back in range(recent, 0, -1):
        past = said.select("_c", (F.col("turn") + back).alias("_t"), F.col("_said").alias(f"_b{back}"))
        out = out.join(past, (F.col(conversation) == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t")
    before = F.concat_ws("\n", *[f"_b{back}" for back in range(recent, 0, -1)])
    text = F.concat(F.lit("【上下文】\n"), before, F.lit("\n\n用户问题："), F.col("query"))
    return out.select(conversation, "turn", F.when(F.col("_b1").isNotNull(), text).otherwise(F.col("query")).alias("enriched"))


def passed_on(rows: DataFrame, conversation: str, recent: int = 2, cut: int = 200, limit: int = 6) -> DataFrame:
    """conversation, turn, passed_on, context_source: a question that refers back gets the summary, once more than `limit` turns are
    before it, and the last turns; any other stays as it is."""
    before = enriched(rows, conversation, recent, cut).withColumnRenamed("enriched", "_e")
    both = rows.select(conversation, "turn", "query").join(before, [conversation, "turn"]).join(summaries(rows, conversation), conversation, "left")
    refers = (F.col("_e") != F.col("query")) & asks_back(F.col("query"))
    told = F.when((F.col("turn") > limit + 1) & F.col("summary").isNotNull(), F.concat(F.lit("摘要: "), "summary", F.lit("\n"))).otherwise("")
    head = F.lit("【上下文】\n")
    full = F.concat(head, told, F.substring(F.col("_e"), F.length(head) + 1, F.length("_e")))
    return both.select(conversation, "turn", F.when(refers, full).otherwise(F.col("query")).alias("passed_on"), F.when(refers, "recent_turns").otherwise("none").alias("context_source"))


def windows(rows: DataFrame, conversation: str, limit: int = 6, keep: int = 2) -> DataFrame:
    """conversation, turn, summarised, kept after each turn: with more than `limit` turns in the window all but the last
    `keep` are summarised. In closed form, as the window refills by limit - keep + 1 turns between two summaries."""
    period = limit + 1 - keep
    done = F.when(F.col("turn") > limit, F.floor((F.col("turn") - limit - 1) / period) + 1).otherwise(0)
    summarised = F.when(done > 0, (limit + 1 - keep) + (done - 1) * period).otherwise(0)
    return rows.select(conversation, "turn", done.cast("int").alias("summaries"), summarised.cast("int").alias("summarised"), (F.col("turn") - summarised).cast("int").alias("kept"))


def summaries(rows: DataFrame, conversation: str, first: int = 5) -> DataFrame:
    """conversation, summary: its first questions. Only those are gathered, however long the conversation."""
    # How a summary begins.
    few = rows.where(F.col("turn") <= first)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "query"))), lambda x: x["query"])
    return few.groupBy(conversation).agg(F.concat(F.lit("用户询问了: "), F.array_join(listed, ", ")).alias("summary"))
