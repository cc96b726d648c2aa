"""Queries of contexts, conversations and evaluation. A run of evaluation items stands for a conversation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as X
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..session import read
from . import retrieval as Q

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def ranked_texts(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(Q.asked(spark, d), Q.documents(spark, d), Q.K).join(Q.documents(spark, d), "doc_id").select("query_id", "rank", "text")


_RANKED = f"(select query_id, rank, text from ({Q._bm25(Q._ASKED)}) join documents using (doc_id))"


def _budget(piece: str, size: str, budget: int) -> str:
    return f"select query_id, string_agg(piece, chr(10) || chr(10) order by rank) context, count(*) used from (select *, sum({size}) over (partition by query_id order by rank) total from (select query_id, rank, {piece} piece from {_RANKED})) where total <= {budget} group by 1"


@query
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return X.within_budget(ranked_texts(spark, d), 6000, True)


SQL["context_budget"] = _budget("'[' || rank || '] ' || text", "length(piece) + 2", 6000)


@query
def context_truncate(spark: SparkSession, d: str) -> DataFrame:
    return X.within_budget(ranked_texts(spark, d), 8000, False)


SQL["context_truncate"] = _budget("text", "length(piece)", 8000)


@query
def context_whole(spark: SparkSession, d: str) -> DataFrame:
    """As context_truncate with the reference's budget of 80 000; a query whose first text does not fit has an empty context."""
    return X.within_budget(ranked_texts(spark, d), 80_000, False, keep_empty=True)


SQL["context_whole"] = f"select query_id, coalesce(context, '') context, coalesce(used, 0) used from (select distinct query_id from {_RANKED}) left join ({_budget('text', 'length(piece)', 80_000)}) using (query_id)"


@query
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    c = context_budget(spark, d).join(Q.asked(spark, d), "query_id")
    return c.select("query_id", X.prompt("compact", context_str=F.col("context"), query_str=F.col("query_text")).alias("prompt"))


def _prompt(style: str, **values: str) -> str:
    parts = re.split(r"\{(\w+)\}", X.PROMPTS[style])
    return " || ".join(values[p] if i % 2 else f"'{p}'" for i, p in enumerate(parts))


SQL["prompt_build"] = f"select query_id, {_prompt('compact', context_str='context', query_str='query_text')} prompt from ({SQL['context_budget']}) join {Q._ASKED} using (query_id)"


@query
def prompt_refine(spark: SparkSession, d: str) -> DataFrame:
    """The stored response of each question put up for refinement with the best text that was found."""
    best = ranked_texts(spark, d).where("rank = 1").join(Q.asked(spark, d), "query_id")
    said = read(spark, d, "eval_items").where("item_id is not null").groupBy(F.col("item_id").alias("query_id")).agg(F.min(F.coalesce("response", F.lit(""))).alias("response"))
    return best.join(said, "query_id").select("query_id", X.prompt("refine", existing_answer=F.col("response"), context_msg=F.col("text"), query_str=F.col("query_text")).alias("prompt"))


SQL["prompt_refine"] = f"select query_id, {_prompt('refine', existing_answer='response', context_msg='text', query_str='query_text')} prompt from (select * from {_RANKED} where rank = 1) join {Q._ASKED} using (query_id) join (select item_id query_id, min(coalesce(response, '')) response from eval_items where item_id is not null group by 1) using (query_id)"


@query
def format_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per query the sources of its results as one text, each source once at its best rank."""
    r = R.bm25(Q.asked(spark, d), Q.documents(spark, d), Q.K).join(read(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source")), "doc_id")
    best = r.groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]), "; ").alias("sources"))


SQL["format_sources"] = f"select query_id, string_agg(source, '; ' order by rank) sources from (select query_id, source, min(rank) rank from (select query_id, rank, coalesce(source, 'unknown') source from ({Q._bm25(Q._ASKED)}) join documents using (doc_id)) group by all) group by 1"


def conversation(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "eval_items").where("query is not null and run_id is not null")
    once = items.groupBy("item_id", "run_id", "query").agg(F.coalesce(F.min("response"), F.lit("")).alias("response"))
    return X.turns(once, "run_id", "item_id")


_TURNS = "(select *, row_number() over (partition by run_id order by item_id) turn from (select item_id, run_id, query, coalesce(min(response), '') response from eval_items where query is not null and run_id is not null group by all))"


@query
def conv_enrich(spark: SparkSession, d: str) -> DataFrame:
    return X.enriched(conversation(spark, d), "run_id")


SQL["conv_enrich"] = f"""select run_id, turn::int turn, case when b is null then query else '【上下文】' || chr(10) || b || chr(10) || chr(10) || '用户问题：' || query end enriched from (
select run_id, turn, query, string_agg('问: ' || query || chr(10) || '答: ' || substring(response, 1, 200), chr(10)) over (partition by run_id order by turn rows between 2 preceding and 1 preceding) b from {_TURNS})"""


@query
def conv_window(spark: SparkSession, d: str) -> DataFrame:
    return X.windows(conversation(spark, d), "run_id")


SQL["conv_window"] = f"select run_id, turn::int turn, s::int summaries, (5 * s)::int summarised, (turn - 5 * s)::int kept from (select run_id, turn, case when turn > 6 then (turn - 7) // 5 + 1 else 0 end s from {_TURNS})"


@query
def conv_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.summaries(conversation(spark, d), "run_id")


SQL["conv_summary"] = f"select run_id, '用户询问了: ' || string_agg(query, ', ' order by turn) summary from {_TURNS} where turn <= 5 group by 1"


@query
def conv_export(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as one JSON row."""
    return conversation(spark, d).select("run_id", F.col("turn").cast("int").alias("turn"), F.to_json(F.struct("run_id", "turn", "query")).alias("json"))


SQL["conv_export"] = f"select run_id, turn::int turn, json_object('run_id', run_id, 'turn', turn, 'query', query)::varchar json from {_TURNS}"


def judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Results for the first 12 words of documents, and the documents of the same text as what should be found."""
    docs = read(spark, d, "documents").where("text is not null")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", "[ \t\r\n]+"), 1, 12), " ").alias("query_text"), F.md5("text").alias("h"))
    expected = asked.join(docs.select("doc_id", F.md5("text").alias("h")), "h").select("query_id", "doc_id")
    return R.bm25(asked.select("query_id", "query_text"), Q.documents(spark, d), Q.K), expected


@query
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.retrieval_metrics(*judged(spark, d))


_JUDGED = r"(select doc_id query_id, array_to_string(list_slice(string_split_regex(text, '[ \t\r\n]+'), 1, 12), ' ') query_text, md5(text) h from documents where text is not null and doc_id % 50 = 0)"
SQL["retrieval_metrics"] = f"""with r as ({Q._bm25(_JUDGED)}), e as (select query_id, doc_id from {_JUDGED} t join (select doc_id, md5(text) h from documents where text is not null) using (h)),
h as (select r.query_id, rank, (e.doc_id is not null)::int rel, sum((e.doc_id is not null)::int) over (partition by r.query_id order by rank) seen from r left join e on r.query_id = e.query_id and r.doc_id = e.doc_id),
n as (select query_id, count(*) n from e group by 1),
g as (select query_id, count(*) got, sum(rel) hits, min(case when rel = 1 then rank end) f, sum(case when rel = 1 then seen / rank else 0 end) ap, sum(case when rel = 1 then 1 / log2(rank + 1) else 0 end) dcg from h group by 1)
select query_id, (coalesce(hits, 0) > 0)::int::double hit_rate, round(coalesce(1.0 / f, 0), 6)::double mrr, round(coalesce(hits / got, 0), 6) "precision", round(coalesce(hits, 0) / n, 6) recall, round(coalesce(ap, 0) / n, 6) ap, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))), 6) ndcg
from n left join g using (query_id)"""


@query
def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means of the stored retrieval metrics per run; a metric that an item lacks counts 0, items without any are left out."""
    return E.metrics_summary(read(spark, d, "eval_items").where("item_id is not null and retrieval_metrics is not null").select("item_id", "run_id", "retrieval_metrics").dropDuplicates(["item_id"]))


_METRICS = ("hit_rate", "mrr", "precision", "recall", "ndcg", "ap")
SQL["metrics_summary"] = "select run_id, metric, sum(round(coalesce(retrieval_metrics[metric], 0) * 10000)::bigint)::double / (count(*) * 10000.0::double) mean, count(*) items from (select distinct on (item_id) * from eval_items where item_id is not null and retrieval_metrics is not null), (select unnest(['" + "', '".join(_METRICS) + "']) metric) group by 1, 2"


@query
def response_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per judge: mean score, passing rate, both over what is known, and items in all."""
    return E.response_summary(read(spark, d, "eval_items").where("item_id is not null and response_metrics is not null").select("item_id", "response_metrics").dropDuplicates(["item_id"]))


SQL["response_summary"] = """select evaluator, round(avg(score), 6) avg_score, round(avg(passing::int), 6) passing_rate, count(*) items from (
select evaluator, json_extract_string(response_metrics, '$.' || evaluator || '.score')::double score, json_extract_string(response_metrics, '$.' || evaluator || '.passing')::boolean passing from (
select response_metrics, unnest(json_keys(response_metrics)) evaluator from (select distinct on (item_id) * from eval_items where item_id is not null and response_metrics is not null))) group by 1"""


@query
def eval_run(spark: SparkSession, d: str) -> DataFrame:
    """Queries searched and judged in one plan: means over all of them."""
    m = retrieval_metrics(spark, d)
    return m.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in ("hit_rate", "mrr", "precision", "recall", "ap", "ndcg")])


SQL["eval_run"] = "select count(*) queries, " + ", ".join(f'round(avg("{c}"), 4) "{c}"' for c in ("hit_rate", "mrr", "precision", "recall", "ap", "ndcg")) + f" from ({SQL['retrieval_metrics']})"


@query
def eval_dataset(spark: SparkSession, d: str) -> DataFrame:
    """An evaluation set: of every source the chunk whose md5 is least, with the start of its text and its id as what should be found."""
    n = read(spark, d, "kb_nodes").where("node_id is not null and source_file is not null and text is not null")
    best = n.groupBy("source_file").agg(F.min_by(F.struct("node_id", "text"), F.struct(F.md5("node_id"), F.col("node_id"))).alias("n"))
    return best.select("source_file", F.col("n.node_id").alias("expected_id"), F.substring("n.text", 1, 500).alias("expected_text"))


SQL["eval_dataset"] = "select source_file, node_id expected_id, substring(text, 1, 500) expected_text from (select *, row_number() over (partition by source_file order by md5(node_id), node_id) r from kb_nodes where node_id is not null and source_file is not null and text is not null) where r = 1"


@query
def parse_config(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the form name:number:number read as splitter configurations type:size:overlap, with defaults for what is no number.

    The tables hold no configurations; every first line of a document is read as one, as any text may be given for it.
    """
    c = read(spark, d, "documents").where("text is not null").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("config"))
    number = "try_cast(regexp_extract(split_part(config, ':', {0}), '^ *([+-]?[0-9]{{1,9}}) *$', 1) as int)"
    return c.select("doc_id", F.split_part("config", F.lit(":"), F.lit(1)).alias("kind"), F.coalesce(F.expr(number.format(2)), F.lit(512)).alias("size"), F.coalesce(F.expr(number.format(3)), F.lit(50)).alias("overlap"))


_NUMBER = "try_cast(regexp_extract(split_part(c, ':', {0}), '^ *([+-]?[0-9]{{1,9}}) *$', 1) as int)"
SQL["parse_config"] = f"select doc_id, split_part(c, ':', 1) kind, coalesce({_NUMBER.format(2)}, 512) size, coalesce({_NUMBER.format(3)}, 50) overlap from (select doc_id, split_part(text, chr(10), 1) c from documents where text is not null)"
