"""Queries of rule-based extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as X
from ..session import read, spread

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").where("text is not null").select("doc_id", "text"))


def _sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _codes(text: str) -> str:
    every = ", ".join(f"regexp_extract_all({text}, '(?i){p}')" for p in X.ERROR_CODES)
    five = f"list_filter(regexp_extract_all({text}, '[0-9A-Za-z_]+'), lambda x: regexp_full_match(x, '\\d{{5}}'))"
    return f"list_sort(list_distinct(list_transform(flatten([{every}, {five}]), lambda x: case when contains(x, '-') or regexp_full_match(x, '[A-Za-z]+') then upper(x) else x end)))"


def _logs(text: str) -> str:
    return "list_sort(list_distinct(list_transform(flatten([" + ", ".join(f"regexp_extract_all({text}, '(?i){p}')" for p in X.LOG_PHRASES) + "]), lambda x: lower(x))))"


def _services(text: str) -> str:
    return f"list_sort(list_filter({_sql(X.SERVICES)}, lambda p: contains(lower({text}), p)))"


def _words(text: str) -> str:
    parts = [f"case when len(list_filter({_sql(w)}, lambda x: contains(lower({text}), lower(x)))) > 0 then list_prepend('{n}', list_filter({_sql(w)}, lambda x: contains(lower({text}), lower(x)))) else [] end" for n, w in X.PROBLEMS.items()]
    return f"list_sort(list_distinct(flatten([{', '.join(parts)}])))"


@query
def rule_error_codes(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.error_codes(F.col("text")).alias("codes"))


SQL["rule_error_codes"] = f"select doc_id, {_codes('text')} codes from documents where text is not null"


@query
def rule_log_patterns(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.log_phrases(F.col("text")).alias("phrases"))


SQL["rule_log_patterns"] = f"select doc_id, {_logs('text')} phrases from documents where text is not null"


@query
def rule_services(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.services(F.col("text")).alias("services"))


SQL["rule_services"] = f"select doc_id, {_services('text')} services from documents where text is not null"


@query
def rule_keywords(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.problem_words(F.col("text")).alias("keywords"))


SQL["rule_keywords"] = f"select doc_id, {_words('text')} keywords from documents where text is not null"


@query
def rule_environment(spark: SparkSession, d: str) -> DataFrame:
    """Environment named in the extractor's replies; one row per entry."""
    r = read(spark, d, "llm_replies").where("reply is not null").select("reply_id", "reply").distinct()
    return r.select("reply_id", F.explode(X.environment(F.col("reply"))).alias("e")).select("reply_id", "e.key", "e.value")


_ENV = []
for _category, _patterns in X.ENVIRONMENT.items():
    for _p in _patterns:
        _ENV.append(f"{{'key': '{_category}_' || lower(regexp_extract(reply, '(?i){_p}', 1)), 'value': case when regexp_extract(reply, '(?i){_p}', 1) <> '' then regexp_extract(reply, '(?i){_p}', 1) || ' ' || regexp_extract(reply, '(?i){_p}', 2) end}}")
    _ENV.append(f"{{'key': '{_category}', 'value': coalesce(" + ", ".join(f"case when regexp_extract(reply, '(?i){_p}', 1) <> '' then regexp_extract(reply, '(?i){_p}', 1) || ' ' || regexp_extract(reply, '(?i){_p}', 2) end" for _p in _patterns) + ")}")
SQL["rule_environment"] = f"select reply_id, e.key as key, e.value as value from (select reply_id, unnest([{', '.join(_ENV)}]) e from (select distinct reply_id, reply from llm_replies where reply is not null)) where e.value is not null"


@query
def rule_extract(spark: SparkSession, d: str) -> DataFrame:
    """All rules at once, on 10 000 characters at most as their definition has it; nothing from texts of under 100."""
    head = F.substring("text", 1, 10_000)
    fit = F.length("text") >= 100
    none = F.array().cast("array<string>")
    return docs(spark, d).select("doc_id", *[F.when(fit, f(head)).otherwise(none).alias(n) for n, f in (("codes", X.error_codes), ("phrases", X.log_phrases), ("services", X.services), ("keywords", X.problem_words))])


_HEAD = "substring(text, 1, 10000)"
SQL["rule_extract"] = "select doc_id, " + ", ".join(f"case when length(text) >= 100 then {f(_HEAD)} else [] end {n}" for n, f in (("codes", _codes), ("phrases", _logs), ("services", _services), ("keywords", _words))) + " from documents where text is not null"


@query
def conv_ref(spark: SparkSession, d: str) -> DataFrame:
    """Whether texts refer back to something said; the questions of this data hardly do, so documents are looked at too."""
    q = read(spark, d, "eval_items").where("query is not null").select(F.lit("eval_items").alias("src"), F.col("query").alias("t")).distinct()
    t = docs(spark, d).select(F.lit("documents").alias("src"), F.col("text").alias("t"))
    return q.unionByName(t).groupBy("src", X.asks_back(F.col("t")).alias("refers")).agg(F.count("*").alias("n"))


_REF = "|".join(f"(?:{p})" for p in X.REFERENCES)
SQL["conv_ref"] = f"select src, regexp_matches(t, '{_REF}') refers, count(*) n from (select distinct 'eval_items' src, query t from eval_items where query is not null union all select 'documents', text from documents where text is not null) group by all"


@query
def score_parse(spark: SparkSession, d: str) -> DataFrame:
    """The last number of each response as a score."""
    r = read(spark, d, "eval_items").where("response is not null").select("item_id", "response").distinct()
    return r.select("item_id", X.last_score(F.col("response")).alias("score"))


SQL["score_parse"] = r"select item_id, coalesce(least(greatest(list_filter(regexp_extract_all(response, '[0-9]*\.?[0-9]+'), lambda x: x <> '')[-1]::double, 0.0), 1.0), 0.5) score from (select distinct item_id, response from eval_items where response is not null)"


@query
def meta_filter(spark: SparkSession, d: str) -> DataFrame:
    """Metadata that is stored, one row per entry."""
    n = read(spark, d, "kb_nodes").where("metadata is not null").select("node_id", "metadata").distinct()
    kept = X.stored_metadata(F.from_json("metadata", "map<string,string>"))
    return n.select("node_id", F.explode(kept).alias("key", "value"))


SQL["meta_filter"] = f"select node_id, key, json_extract_string(metadata, '$.\"' || key || '\"') as value from (select node_id, metadata, unnest(json_keys(metadata)) key from (select distinct node_id, metadata from kb_nodes where metadata is not null)) where lower(key) not in ({', '.join(map(repr, X.LARGE_KEYS))}) and length(json_extract_string(metadata, '$.\"' || key || '\"')) <= {X.LARGE_VALUE}"


@query
def parse_variants(spark: SparkSession, d: str) -> DataFrame:
    """Responses read as a model's list of query variants: the first 3 lines without lead-ins and numbers."""
    r = read(spark, d, "eval_items").where("response is not null").select("item_id", "response").distinct()
    return r.select("item_id", X.parsed_variants(F.col("response")).alias("variants"))


SQL["parse_variants"] = r"select item_id, list_slice(list_transform(list_filter(list_transform(string_split(response, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' and not regexp_matches(x, '^(Query|Alternative|Version|-)')), lambda x: trim(regexp_replace(x, '^\d[.: ] ?', ''), ' ')), 1, 3) variants from (select distinct item_id, response from eval_items where response is not null)"


@query
def llm_json_parse(spark: SparkSession, d: str) -> DataFrame:
    """Description and confidence from replies: the fenced JSON, else the whole, else from the first to the last brace."""
    r = read(spark, d, "llm_replies").where("reply is not null").select("reply_id", "reply").distinct()
    fenced = F.regexp_extract("reply", r"(?s)```json\s*(.*?)\s*```", 1)
    braces = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    value = F.coalesce(*[F.try_parse_json(F.when(c != "", c)) for c in (fenced, F.col("reply"), braces)])
    return r.select("reply_id", F.try_variant_get(value, "$.problem.description", "string").alias("description"), F.try_variant_get(value, "$.confidence_score", "double").alias("confidence"))


_C = r"coalesce(case when json_valid(nullif(regexp_extract(reply, '(?s)```json\s*(.*?)\s*```', 1), '')) then regexp_extract(reply, '(?s)```json\s*(.*?)\s*```', 1) end, case when json_valid(reply) then reply end, case when json_valid(nullif(regexp_extract(reply, '(?s)(\{.*\})', 1), '')) then regexp_extract(reply, '(?s)(\{.*\})', 1) end)"
SQL["llm_json_parse"] = f"select reply_id, json_extract_string(c, '$.problem.description') description, try_cast(json_extract_string(c, '$.confidence_score') as double) confidence from (select reply_id, {_C}::json c from (select distinct reply_id, reply from llm_replies where reply is not null))"


@query
def clean_stats(spark: SparkSession, d: str) -> DataFrame:
    """Extracted documents in all, passed and rejected, with images, per source."""
    c = read(spark, d, "cleaned_docs").select("record_id", "source_file", "quality.passed", F.size("images").alias("images")).distinct()
    return c.groupBy("source_file").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(F.col("passed") == False).alias("rejected"), F.coalesce(F.sum(F.greatest("images", F.lit(0))), F.lit(0)).alias("images"))  # noqa: E712


SQL["clean_stats"] = "select source_file, count(*) total, count(*) filter (where passed) passed, count(*) filter (where passed = false) rejected, coalesce(sum(greatest(images, 0)), 0)::bigint images from (select distinct record_id, source_file, quality.passed passed, len(images) images from cleaned_docs) group by 1"


@query
def clean_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Extracted documents as Markdown: title, problem, symptoms, cause, steps; parts without content are left out."""

    def part(head: str, body) -> F.Column:
        return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {head}\n\n"), body))

    def items(c: str):
        return F.array_join(F.transform(F.filter(c, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), lambda x: F.concat(F.lit("- "), x)), "\n")

    c = read(spark, d, "cleaned_docs").groupBy("record_id").agg(*[F.first(x).alias(x) for x in ("original_title", "problem", "cause", "solution")])
    title = F.concat(F.lit("# "), F.coalesce("original_title", F.lit("")))
    return c.select("record_id", F.concat_ws("\n\n", title, part("problem", F.col("problem.description")), part("symptoms", items("problem.symptoms")), part("cause", F.col("cause.root_cause")), part("steps", items("solution.steps"))).alias("markdown"))


_ITEMS = "array_to_string(list_transform(list_filter({0}, lambda x: coalesce(trim(x), '') <> ''), lambda x: '- ' || x), chr(10))"


def _part(head: str, body: str) -> str:
    return f"case when coalesce({body}, '') <> '' then '## {head}' || chr(10) || chr(10) || {body} end"


SQL["clean_to_markdown"] = f"select record_id, concat_ws(chr(10) || chr(10), '# ' || coalesce(original_title, ''), {_part('problem', 'problem.description')}, {_part('symptoms', _ITEMS.format('problem.symptoms'))}, {_part('cause', 'cause.root_cause')}, {_part('steps', _ITEMS.format('solution.steps'))}) markdown from (select distinct on (record_id) * from cleaned_docs)"
