"""Queries of the quality gate, cleaning in one plan, results put together as texts, and formatted texts read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators import context as X
from ..operators import extraction as E
from ..operators import gates as G
from ..operators import retrieval as R
from ..session import read
from . import contexts as C
from . import retrieval as Q
from . import rules as L

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def records(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "cleaned_docs").where("record_id is not null").dropDuplicates(["record_id"])
    text = G.record_text(F.col("original_title"), F.col("problem.description"), F.col("cause.root_cause"), F.col("solution.steps"))
    return c.select(
        "record_id", "source_file", text.alias("text"), F.col("original_title").alias("title"), F.col("problem.description").alias("problem"), "solution.steps", "solution.commands",
        F.col("solution.troubleshooting_steps.command").alias("step_commands"), F.col("quality.completeness_score").alias("completeness"), F.col("quality.no_contradictions").alias("consistent"),
    )


_SOME = "coalesce(len({0}) > 0, false)"
_RECORDS = """(select record_id, source_file, original_title title, concat_ws(chr(10) || chr(10), original_title, problem.description, cause.root_cause, array_to_string(solution.steps, chr(10))) as text,
problem.description problem, solution.steps steps, solution.commands commands, list_transform(solution.troubleshooting_steps, lambda x: x.command) step_commands,
quality.completeness_score completeness, quality.no_contradictions consistent from (select distinct on (record_id) * from cleaned_docs where record_id is not null))"""
_ACTS = " or ".join(f"contains(lower(array_to_string(steps, ' ')), '{w}')" for w in G.ACTIONS)
_GATED = f"""(select *, issues[1] reason, len(issues) = 0 passed from (select *, list_filter([
case when length(text) < {G.LEAST_CHARS} then '{G.TOO_SHORT}' end, case when not has_solution then '{G.NO_SOLUTION}' end,
case when not (coalesce(problem, '') <> '' and ({_SOME.format('steps')} or {_SOME.format('commands')})) then '{G.NOT_COMPLETE}' end,
case when coalesce(completeness, {G.USUAL_SCORE}) < {G.LEAST_SCORE} then '{G.LOW_SCORE}' end, case when not coalesce(consistent, true) then '{G.CONTRADICTS}' end], lambda x: x is not null) issues
from (select *, coalesce({_SOME.format('steps')} and ({_ACTS}), false) or {_SOME.format('commands')} or coalesce(len(list_filter(step_commands, lambda x: coalesce(x, '') <> '')) > 0, false) has_solution from {_RECORDS})))"""


@query
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether extracted documents pass the gate, all issues of those that do not, and the first as the reason."""
    return G.gate(records(spark, d)).select("record_id", "has_solution", "issues", "reason", "passed")


SQL["quality_gate"] = f"select record_id, has_solution, issues, reason, passed from {_GATED}"


@query
def gate_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source and reason of rejection; a null reason stands for those that pass."""
    return G.gate(records(spark, d)).groupBy("source_file", "reason").agg(F.count("*").alias("n"))


SQL["gate_report"] = f"select source_file, reason, count(*) n from {_GATED} group by all"


@query
def clean_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Rules, gate and assembly in one plan: the documents that pass, with what the rules found in their texts."""
    t = F.col("text")
    found = [f(t).alias(n) for n, f in (("codes", E.error_codes), ("phrases", E.log_phrases), ("services", E.services), ("keywords", E.problem_words))]
    return G.gate(records(spark, d)).where("passed").select("record_id", "source_file", F.coalesce("title", F.lit("")).alias("title"), "problem", "steps", *found)


SQL["clean_pipeline"] = "select record_id, source_file, coalesce(title, '') title, problem, steps, " + ", ".join(f"{f('text')} {n}" for n, f in (("codes", L._codes), ("phrases", L._logs), ("services", L._services), ("keywords", L._words))) + f" from {_GATED} where passed"


@query
def hint_lines(spark: SparkSession, d: str) -> DataFrame:
    """What the rules find in a reply, as lines for the next prompt."""
    r = read(spark, d, "llm_replies").where("reply is not null").select("reply_id", "reply").distinct()
    t = F.col("reply")
    return r.select("reply_id", G.hints(E.error_codes(t), E.log_phrases(t), E.environment(t), E.services(t), E.problem_words(t)).alias("hints"))


_PAIRS = f"list_transform(list_filter([{', '.join(L._ENV)}], lambda e: e.value is not null), lambda e: e.key || ': ' || e.value)"
_LINES = ", ".join(f"case when len({c}) > 0 then '{n}' || array_to_string({c}, ', ') end" for n, c in zip(G.HINTS, ("a", "b", "e", "s", "k")))
SQL["hint_lines"] = f"select reply_id, coalesce(nullif(concat_ws(chr(10), {_LINES}), ''), '{G.NO_HINTS}') hints from (select reply_id, {L._codes('reply')} a, {L._logs('reply')} b, {_PAIRS} e, {L._services('reply')} s, {L._words('reply')} k from (select distinct reply_id, reply from llm_replies where reply is not null))"


@query
def parse_variants_tool(spark: SparkSession, d: str) -> DataFrame:
    """Responses read as the search tool reads a model's list of variants; without any, the query itself."""
    r = read(spark, d, "eval_items").where("response is not null").select("item_id", F.coalesce("query", F.lit("")).alias("query"), "response").distinct()
    return r.select("item_id", G.tool_variants(F.col("response"), F.col("query")).alias("variants"))


_BARE = r"regexp_replace({0}, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g')"
_CUT = rf"list_filter(list_transform(list_filter(list_transform(string_split(response, chr(10)), lambda x: {_BARE.format('x')}), lambda x: x <> '' and not regexp_matches(x, '^(?:{'|'.join(G.LEAD_INS)})')), lambda x: case when length(x) > 2 and regexp_matches(x, '^[0-9][.: ]') then {_BARE.format('substring(x, 3)')} else x end), lambda x: x <> '')"
SQL["parse_variants_tool"] = f"select item_id, list_slice(case when len(v) > 0 then v else [query] end, 1, 3) variants from (select item_id, query, {_CUT} v from (select distinct item_id, coalesce(query, '') query, response from eval_items where response is not null))"


@query
def conv_query(spark: SparkSession, d: str) -> DataFrame:
    """Each question as it is passed on: with the summary and the last turns if it refers back, else as it is."""
    return X.passed_on(C.conversation(spark, d), "run_id")


_RECENT = "string_agg('问: ' || query || chr(10) || '答: ' || substring(response, 1, 200), chr(10)) over (partition by run_id order by turn rows between 2 preceding and 1 preceding)"
SQL["conv_query"] = f"""select run_id, turn::int turn, case when refers then '【上下文】' || chr(10) || concat_ws(chr(10), case when turn > 7 then '摘要: ' || summary end, b) || chr(10) || chr(10) || '用户问题：' || query else query end passed_on,
case when refers then 'recent_turns' else 'none' end context_source from (
select *, b is not null and regexp_matches(query, '{L._REF}') refers from (select run_id, turn, query, {_RECENT} b from {C._TURNS}) left join ({C.SQL['conv_summary']}) using (run_id))"""


@query
def conv_import(spark: SparkSession, d: str) -> DataFrame:
    """Exported turns read back."""
    out = C.conv_export(spark, d).select(F.from_json("json", "run_id string, turn int, query string").alias("j"))
    return out.select("j.run_id", "j.turn", "j.query")


SQL["conv_import"] = f"select run_id, turn::int turn, query from {C._TURNS}"


@query
def image_context(spark: SparkSession, d: str) -> DataFrame:
    """Images of documents with the text around them."""
    return G.image_contexts(read(spark, d, "documents"))


_IMG = r"!\[([^\]]*)\]\(([^)]+)\)"
SQL["image_context"] = rf"""select doc_id, (i - 1)::int as position, regexp_extract(m, '{_IMG}', 2) path, regexp_extract(m, '{_IMG}', 1) alt,
{_BARE.format("right(b, 100) || ' ' || left(a, 100)")} context from (
select doc_id, i, m, {_BARE.format("substring(x, greatest(s - 200, 0) + 1, s - greatest(s - 200, 0))")} b, {_BARE.format("substring(x, s + length(m) + 1, 200)")} a from (
select *, f[i] m, coalesce(list_sum(list_transform(p[1:i], lambda y: length(y))), 0)::bigint + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0)::bigint s from (
select *, unnest(range(1, len(f) + 1)) i from (select doc_id, text x, string_split_regex(text, '{_IMG}') p, regexp_extract_all(text, '{_IMG}') f from documents where contains(text, '![')))))"""


@query
def retrieve_images(spark: SparkSession, d: str) -> DataFrame:
    """The best 10 texts of a query, and the images that they show, each path once with its best score."""
    texts = R.bm25(Q.asked(spark, d), Q.documents(spark, d), Q.K)
    shown = Q.documents(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(Q._IMAGE), F.lit(1))).alias("path"))
    images = texts.join(shown, "doc_id").groupBy("query_id", "path").agg(F.max("score").alias("score"))
    a = texts.select("query_id", F.lit("text").alias("kind"), F.col("doc_id").cast("string").alias("item"), "score")
    return a.unionByName(images.select("query_id", F.lit("image").alias("kind"), F.col("path").alias("item"), "score"))


_FOUND = f"({Q._bm25(Q._ASKED)})"
SQL["retrieve_images"] = f"with r as {_FOUND} select query_id, 'text' kind, doc_id::varchar item, score from r union all select query_id, 'image', path, max(score) from (select query_id, score, unnest(regexp_extract_all(text, '{Q._IMAGE}', 1)) path from r join documents using (doc_id)) group by query_id, path"


def top_texts(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    return R.bm25(Q.asked(spark, d), docs, k).join(docs, "doc_id")


_TOP3 = f"(select query_id, rank, score, text, source from {_FOUND} join documents using (doc_id) where rank <= 3)"


@query
def answer_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Each question's stored response with the images and the texts that were found, as Markdown."""
    rows = top_texts(spark, d)
    sources = G.numbered_blocks(rows, "query_id", "rank", G.source_block(F.col("rank"), F.col("score"), F.col("text")), "sources")
    shown = rows.select("query_id", F.posexplode(F.regexp_extract_all("text", F.lit(Q._IMAGE), F.lit(1))).alias("position", "path"), "rank")
    first = shown.groupBy("query_id", "path").agg(F.min(F.struct("rank", "position")).alias("at"))
    listed = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("x"))
    images = listed.select("query_id", F.array_join(F.transform("x", lambda v, i: G.image_block(i + 1, v["path"])), "").alias("images"))
    answers = read(spark, d, "eval_items").where("item_id is not null").groupBy(F.col("item_id").alias("query_id")).agg(F.min(F.coalesce("response", F.lit(""))).alias("response"))
    text = F.concat(F.lit("## Response\n\n"), "response", F.lit("\n"), F.coalesce(F.concat(F.lit("\n## Related Images\n"), "images"), F.lit("")), F.lit("\n## Sources\n"), "sources")
    return sources.join(images, "query_id", "left").join(answers, "query_id").select("query_id", text.alias("markdown"))


_BLOCK = "'\n### Source [' || rank || '] (Score: ' || printf('%.3f', score) || ')\n```\n' || substring(text, 1, 300) || case when length(text) > 300 then '...' else '' end || '\n```'"
_SHOWN = f"(select query_id, rank, unnest(regexp_extract_all(text, '{Q._IMAGE}', 1)) path, unnest(range(len(regexp_extract_all(text, '{Q._IMAGE}', 1)))) as position from {_TOP3})"
SQL["answer_markdown"] = f"""with s as (select query_id, string_agg({_BLOCK}, '' order by rank) sources from {_TOP3} group by 1),
f as (select query_id, path, min((rank, position)) pos from {_SHOWN} group by all),
i as (select query_id, string_agg('\n### Image ' || n || '\n![Image ' || n || '](' || path || ')\n', '' order by n) images from (select *, row_number() over (partition by query_id order by pos) n from f) group by 1),
a as (select item_id query_id, min(coalesce(response, '')) response from eval_items where item_id is not null group by 1)
select query_id, '## Response\n\n' || response || '\n' || coalesce('\n## Related Images\n' || images, '') || '\n## Sources\n' || sources markdown from s left join i using (query_id) join a using (query_id)"""


def tool_text(rows: DataFrame) -> DataFrame:
    block = F.concat(F.lit("[文档"), F.col("rank").cast("string"), F.lit("] 相关度: "), F.format_string("%.3f", "score"), F.lit("\n来源: "), F.coalesce("source", F.lit("unknown")), F.lit("\n内容: "), F.substring("text", 1, 200), F.lit("\n\n"))
    return G.numbered_blocks(rows, "query_id", "rank", block, "result")


@query
def extract_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources read back from results that were formatted as one text: a line that names a document begins one."""
    blocks = tool_text(top_texts(spark, d)).select("query_id", F.posexplode(F.split("result", r"(?m)^(?=\[文档)")).alias("n", "block")).where("block <> ''").withColumn("n", F.col("n") + 1)
    line = lambda head: F.regexp_replace(F.regexp_extract("block", rf"(?m)^{head}:(.*)$", 1), G.SPACES, "")
    return blocks.select("query_id", "n", F.split_part("block", F.lit("\n"), F.lit(1)).alias("index"), line("来源").alias("source"), line("内容").alias("content"))


SQL["extract_sources"] = rf"""select query_id, row_number() over (partition by query_id order by rank)::int n, '[文档' || rank || '] 相关度: ' || printf('%.3f', score) as index, coalesce(source, 'unknown') source,
{_BARE.format("regexp_extract(substring(text, 1, 200), '^[^\\n\\r\\x{85}\\x{2028}\\x{2029}]*')".replace(chr(92) * 2, chr(92)))} as content from {_TOP3}"""


@query
def response_rows(spark: SparkSession, d: str) -> DataFrame:
    """Stored judgements of responses, one row per item and judge."""
    r = read(spark, d, "eval_items").where("item_id is not null and response_metrics is not null").select("item_id", "response_metrics").dropDuplicates(["item_id"])
    return r.select("item_id", F.explode(F.from_json("response_metrics", "map<string,struct<score: double, passing: boolean>>")).alias("evaluator", "v")).select("item_id", "evaluator", "v.score", "v.passing")


SQL["response_rows"] = """select item_id, evaluator, json_extract_string(response_metrics, '$.' || evaluator || '.score')::double score, json_extract_string(response_metrics, '$.' || evaluator || '.passing')::boolean passing from (
select item_id, response_metrics, unnest(json_keys(response_metrics)) evaluator from (select distinct on (item_id) * from eval_items where item_id is not null and response_metrics is not null))"""


@query
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """A line of text per evaluation run: items, and the mean hit rate and reciprocal rank."""
    m = C.metrics_summary(spark, d).where("metric in ('hit_rate', 'mrr')").groupBy("run_id").agg(F.max("items").alias("n"), *[F.max(F.when(F.col("metric") == c, F.col("mean"))).alias(c) for c in ("hit_rate", "mrr")])
    return m.select("run_id", F.format_string("Run %s: %d items, hit_rate %.3f, mrr %.3f", F.coalesce("run_id", F.lit("-")), "n", F.round(F.col("hit_rate"), 3), F.round(F.col("mrr"), 3)).alias("report"))


SQL["run_report"] = f"select run_id, printf('Run %s: %d items, hit_rate %.3f, mrr %.3f', coalesce(run_id, '-'), max(items), round(max(mean) filter (where metric = 'hit_rate'), 3), round(max(mean) filter (where metric = 'mrr'), 3)) report from ({C.SQL['metrics_summary']}) where metric in ('hit_rate', 'mrr') group by 1"

# Suffix of a source file -> its language.
LANGUAGES = {".py": "python", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "cpp", ".hpp": "cpp", ".go": "go"}


@query
def splitter_route(spark: SparkSession, d: str) -> DataFrame:
    """The splitter of every source file: by programming language, by Markdown, else by sentences."""
    ext = F.lower(F.regexp_extract("source_file", r"[^/](\.[^./]+)$", 1))
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)
    return read(spark, d, "kb_nodes").where("source_file is not null").select("source_file").distinct().select("source_file", lang.alias("language"), F.when(lang.isNotNull(), "ast").when(ext == ".md", "markdown").otherwise("sentence").alias("splitter"))


_EXT = r"lower(regexp_extract(source_file, '[^/](\.[^./]+)$', 1))"
_LANG = "case ext " + " ".join(f"when '{k}' then '{v}'" for k, v in LANGUAGES.items()) + " end"
SQL["splitter_route"] = f"select source_file, {_LANG} as language, case when {_LANG} is not null then 'ast' when ext = '.md' then 'markdown' else 'sentence' end splitter from (select distinct source_file, {_EXT} ext from kb_nodes where source_file is not null)"


@query
def dataset_from_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents split into windows of 200 words and made an evaluation set: of every source the chunk whose md5 is least."""
    docs = read(spark, d, "documents").where("text is not null and source is not null").select("doc_id", "source", "text")
    chunks = docs.select("doc_id", "source", F.posexplode(K.token_windows(F.col("text"), 200, 20)).alias("n", "chunk"))
    name = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("n").cast("string"))
    best = chunks.groupBy("source").agg(F.min_by(F.struct(name.alias("expected_id"), "chunk"), F.struct(F.md5(name), name)).alias("c"))
    return best.select("source", "c.expected_id", F.substring("c.chunk", 1, 500).alias("expected_text"))


_CHUNKED = r"""(select doc_id, source, unnest(range(0, greatest(len(w) - 20, 1), 180)) s, w from (select doc_id, source, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '') w from documents where text is not null and source is not null) where len(w) > 0)"""
SQL["dataset_from_documents"] = f"select source, id expected_id, substring(array_to_string(list_slice(w, s + 1, s + 200), ' '), 1, 500) expected_text from (select *, row_number() over (partition by source order by md5(id), id) r from (select *, doc_id || '-' || (s // 180) id from {_CHUNKED})) where r = 1"


@query
def store_points(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as a store takes them: sparse vector of words and their counts, and the payload without large metadata."""
    n = read(spark, d, "kb_nodes").where("node_id is not null").groupBy("node_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max(F.lower(F.trim("ref_doc_id"))).alias("ref_doc_id"))
    words = R.postings(n, "node_id").groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("v"))
    return n.join(words, "node_id", "left").select("node_id", "ref_doc_id", F.length("text").alias("chars"), F.coalesce(F.col("v.term"), F.array().cast("array<string>")).alias("terms"), F.coalesce(F.col("v.tf"), F.array().cast("array<bigint>")).alias("tf"))


SQL["store_points"] = f"""with n as (select node_id, max(coalesce(text, '')) as text, max(lower(trim(ref_doc_id))) ref_doc_id from kb_nodes where node_id is not null group by 1),
w as (select node_id, list(term order by term) terms, list(tf order by term) tf from (select node_id, term, count(*) tf from (select node_id, unnest(regexp_extract_all(lower(text), '{Q.WORD}')) term from n) group by all) group by 1)
select node_id, ref_doc_id, length(text)::int chars, coalesce(terms, []) terms, coalesce(tf, []) tf from n left join w using (node_id)"""
