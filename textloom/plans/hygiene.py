"""Queries over the knowledge-base tables: orphan references and flattened documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flatten
from ..operators.references import node_doc_orphans
from ..session import read

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return node_doc_orphans(read(spark, d, "kb_nodes"), read(spark, d, "kb_docs"))


@query
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return p4_found(spark, d).groupBy("src_table", "ref_month", "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.child_paths(flatten.all_triples(read(spark, d, "cleaned_docs"), read(spark, d, "llm_replies")))


def _table(spark: SparkSession, d: str, group: str, columns: list[str]) -> DataFrame:
    found = flatten.all_triples(read(spark, d, "cleaned_docs"), read(spark, d, "llm_replies"), (group,))
    return flatten.pivot_group(found, group, columns, ("src", "rec_id"))


@query
def p2_steps(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "step", ["description", "command", "result", "value"])


@query
def p2_symptoms(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "symptom", ["value", "text", "since"])


@query
def p2_environment(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "env", ["value"])


def _typed(spark: SparkSession, d: str, group: str, columns: list[str]) -> DataFrame:
    """The same of typed documents alone, which SQL can follow."""
    return flatten.pivot_group(flatten.document_triples(read(spark, d, "cleaned_docs"), (group,)), group, columns)


@query
def p2_doc_steps(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d, "step", ["description", "command", "result"])


@query
def p2_doc_symptoms(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d, "symptom", ["value"])


@query
def p2_doc_environment(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d, "env", ["value"])


_SOLID = r"regexp_matches({0}, '[^\s\x1c-\x1f\x{{85}}\p{{Z}}]')"


def _unrolled(path: str, shown: str, kept: str) -> str:
    rows = f"select record_id, {path}[i] x, i from (select *, unnest(range(1, len({path}) + 1)) i from cleaned_docs)"
    return f"select distinct record_id rec_id, 0::int doc, (i - 1)::varchar ordinal, null::varchar parent, (i - 1)::int as position, {shown} from ({rows}) where {kept}"


_FIELDS = ("description", "command", "result")
SQL["p2_doc_steps"] = _unrolled(
    "solution.troubleshooting_steps",
    ", ".join(f"case when {_SOLID.format(f'x.{c}')} then x.{c} end {c}" for c in _FIELDS),
    " or ".join(_SOLID.format(f"x.{c}") for c in _FIELDS),
)
SQL["p2_doc_symptoms"] = _unrolled("problem.symptoms", 'x as "value"', _SOLID.format("x"))
_NAMES = "select record_id, unnest(map_keys(metadata.environment)) k, unnest(map_values(metadata.environment)) v from cleaned_docs"
SQL["p2_doc_environment"] = rf"""select distinct record_id rec_id, 0::int doc, k ordinal, case when contains(k, '.') then regexp_replace(k, '\.[^.]*$', '') end parent,
case when regexp_matches(regexp_extract(k, '[^.]*$'), '^\d+$') then try_cast(regexp_extract(k, '[^.]*$') as int) end as position, v as "value" from ({_NAMES}) where {_SOLID.format('v')}"""
_KEY = r"nullif(regexp_replace(lower({0}), '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g'), '')"
SQL["p4_found"] = f"""
with n as (select {_KEY.format('node_id')} k, {_KEY.format('ref_doc_id')} r, loaded_at t, deleted_at is not null del from kb_nodes),
d as (select {_KEY.format('ref_doc_id')} k, node_ids, loaded_at t, deleted_at is not null del from kb_docs),
de as (select k, t, {_KEY.format('e')} r from (select k, t, unnest(from_json(node_ids, '["VARCHAR"]')) e from d)),
ns as (select k, min(t) f, max_by(del, t) del from n where k is not null group by k),
ds as (select k, min(t) f, max_by(del, t) del from d where k is not null group by k),
refs as (
  select 'kb_nodes' src_table, n.k, r, min(t) t from n where n.k is not null and r is not null and n.k not in (select k from ns where del) group by n.k, r
  union all
  select 'kb_docs', de.k, r, min(t) from de where de.k is not null and r is not null and de.k not in (select k from ds where del) group by de.k, r),
parents as (select 'kb_nodes' src_table, * from ds union all select 'kb_docs', * from ns)
select * from (
  select refs.src_table, refs.k src_key, refs.r ref_key,
    case when p.k is null then 'missing' when p.del then 'deleted' when p.f > refs.t then 'late' end reason, strftime(refs.t, '%Y-%m') ref_month
  from refs left join parents p on p.src_table = refs.src_table and p.k = refs.r)
where reason is not null"""
SQL["p4_report"] = f"select src_table, ref_month, reason, count(*) n_refs, count(distinct ref_key) n_keys from ({SQL['p4_found']}) group by all"
