"""Queries of the chunkers, over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators import code as Code
from ..session import read, spread
from .documents import _STRIP, _TABLE

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text"))


def _numbered(lists: str) -> str:
    return f"select doc_id, len(c)::int total_chunks, unnest(range(len(c)))::int chunk_index, unnest(c) chunk from ({lists})"


@query
def chunk_token(spark: SparkSession, d: str) -> DataFrame:
    return K.numbered(docs(spark, d), K.token_windows(F.col("text"), 50, 10))


_WORDS = r"(select doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '') w from documents where text is not null)"
SQL["chunk_token"] = _numbered(f"select doc_id, list_transform(range(0, greatest(len(w) - 10, 1), 40), lambda s: array_to_string(list_slice(w, s + 1, s + 50), ' ')) c from {_WORDS} where len(w) > 0")


def _pack(pieces: str, limit: int, glue: str, weight: str, cost: int) -> str:
    first = f"list_transform({pieces}, lambda x: {{'cur': x, 'w': ({weight.format('x')})::bigint, 'out': []::varchar[]}})"
    w = f"a.w + b.w + {cost}"
    fold = f"list_reduce({first}, lambda a, b: case when {w} <= {limit} then {{'cur': a.cur || {glue} || b.cur, 'w': {w}, 'out': a.out}} else {{'cur': b.cur, 'w': b.w, 'out': list_append(a.out, a.cur)}} end)"
    return f"select doc_id, list_append(r.out, r.cur) c from (select doc_id, {fold} r from documents where len({pieces}) > 0)"


@query
def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    return K.numbered(docs(spark, d), K.sentence_chunks(F.col("text")))


_SENT = r"regexp_replace(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), '([。！？])|\n+', '\1' || chr(1), 'g')"
_SENTENCES = f"list_filter(list_transform(string_split({_SENT}, chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
SQL["chunk_sentence"] = _numbered(_pack(_SENTENCES, 500, "' '", "length({0})", 1))


@query
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return K.numbered(docs(spark, d), K.line_chunks(F.col("text")))


SQL["chunk_lines"] = _numbered(_pack("string_split(text, chr(10))", 128, "chr(10)", "length({0}) // 4", 0))


@query
def chunk_chinese(spark: SparkSession, d: str) -> DataFrame:
    return K.numbered(docs(spark, d), K.chinese_chunks(F.col("text")))


_PIECES = f"list_filter(list_transform(string_split(regexp_replace(text, '([。！？；\n]+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_WINDOWS = "list_transform(range(1, length(x) + 1, 462), lambda i: substring(x, i, 512))"
_KEPT = "case when a.cur = '' then a.out else list_append(a.out, a.cur) end"
_FOLD = f"""list_reduce(list_transform(p, lambda x: {{'x': x, 'cur': case when length(x) > 512 then '' else x end, 'out': case when length(x) > 512 then {_WINDOWS} else []::varchar[] end}}), lambda a, b:
case when length(b.x) > 512 then {{'x': '', 'cur': '', 'out': list_concat({_KEPT}, b.out)}} when length(a.cur) + length(b.x) <= 512 then {{'x': '', 'cur': a.cur || b.x, 'out': a.out}}
else {{'x': '', 'cur': case when a.cur = '' then '' else substring(a.cur, greatest(length(a.cur) - 49, 1), 50) end || b.x, 'out': {_KEPT}}} end)"""
SQL["chunk_chinese"] = _numbered(f"select doc_id, case when r.cur = '' then r.out else list_append(r.out, r.cur) end c from (select doc_id, {_FOLD} r from (select doc_id, {_PIECES} p from documents where text is not null) where len(p) > 0)")


@query
def chunk_chars(spark: SparkSession, d: str) -> DataFrame:
    return K.numbered(docs(spark, d), K.char_chunks(F.col("text")))


_LAST = "length(p) - instr(reverse(p), {0})"
SQL["chunk_chars"] = f"""with recursive t as (select doc_id, text from documents where length(text) > 500),
r as (select doc_id, text, 0 start, 0 n, null::varchar chunk from t
union all select doc_id, text, case when e - 50 > start then e - 50 else e end, n + 1, {_STRIP.format("substring(text, start + 1, e - start)")} from (
  select *, case when start + 500 >= length(text) then start + 500 else start + case when instr(p, chr(10)) > 0 and {_LAST.format('chr(10)')} > 250 then {_LAST.format('chr(10)')} + 1 when instr(p, ' ') > 0 and {_LAST.format("' '")} > 250 then {_LAST.format("' '")} + 1 else 500 end end e
  from (select *, substring(text, start + 1, 500) p from r where start < length(text)))),
c as (select doc_id, list(chunk order by n) c from r where chunk <> '' group by doc_id union all select doc_id, [text] from documents where length(text) <= 500)
{_numbered('select * from c')}"""


@query
def chunk_number(spark: SparkSession, d: str) -> DataFrame:
    """Chunk numbers and lengths of sentence chunks."""
    return chunk_sentence(spark, d).select("doc_id", "chunk_index", "total_chunks", F.length("chunk").alias("length"))


SQL["chunk_number"] = f"select doc_id, chunk_index, total_chunks, length(chunk)::int length from ({SQL['chunk_sentence']})"


@query
def split_preview(spark: SparkSession, d: str) -> DataFrame:
    """Of each document the first 20 chunks with 500 characters of each."""
    return chunk_token(spark, d).where("chunk_index < 20").select("doc_id", "chunk_index", F.substring("chunk", 1, 500).alias("preview"), F.length("chunk").alias("char_count"))


SQL["split_preview"] = f"select doc_id, chunk_index, substring(chunk, 1, 500) preview, length(chunk)::int char_count from ({SQL['chunk_token']}) where chunk_index < 20"


@query
def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_sentence(spark, d)
    return c.groupBy("total_chunks").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


SQL["chunk_summary"] = f"select total_chunks, count(distinct doc_id) documents, count(*) chunks, sum(length(chunk))::bigint chars from ({SQL['chunk_sentence']}) group by 1"


@query
def sink_json_shape(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each source as one JSON document a row."""
    c = chunk_sentence(spark, d).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id").where("source is not null")
    packed = c.groupBy("source", "doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.length("chunk").alias("length")))).alias("chunks"))
    return packed.select("source", "doc_id", F.to_json(F.struct("source", "chunks")).alias("json"))


SQL["sink_json_shape"] = f"""select source, doc_id, '{{"source":' || to_json(source)::varchar || ',"chunks":[' || string_agg('{{"chunk_index":' || chunk_index || ',"length":' || length(chunk) || '}}', ',' order by chunk_index) || ']}}' json
from ({SQL['chunk_sentence']}) join documents using (doc_id) where source is not null group by source, doc_id"""


@query
def compare_configs(spark: SparkSession, d: str) -> DataFrame:
    """Chunk statistics of several configurations side by side."""
    out = None
    for size, overlap in ((50, 10), (100, 20), (200, 20)):
        c = K.numbered(docs(spark, d), K.token_windows(F.col("text"), size, overlap)).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg(F.length("chunk")), 6).alias("avg_length"), F.max(F.length("chunk")).alias("max_length"))
        c = c.select(F.lit(f"token:{size}:{overlap}").alias("config"), "*")
        out = c if out is None else out.unionByName(c)
    return out


SQL["compare_configs"] = " union all ".join(
    f"select 'token:{s}:{o}' config, count(*) chunks, count(distinct doc_id) documents, round(avg(length(c)), 6) avg_length, max(length(c))::int max_length from (select doc_id, unnest(list_transform(range(0, greatest(len(w) - {o}, 1), {s - o}), lambda s: array_to_string(list_slice(w, s + 1, s + {s}), ' '))) c from {_WORDS} where len(w) > 0)" for s, o in ((50, 10), (100, 20), (200, 20))
)


@query
def md_elements(spark: SparkSession, d: str) -> DataFrame:
    return K.markdown_elements(docs(spark, d))


SQL["md_elements"] = rf"""with l as (select doc_id, unnest(range(len(s)))::int pos, unnest(s) line from (select doc_id, string_split(text, chr(10)) s from documents)),
f as (select *, {_STRIP.format('line')} s, starts_with({_STRIP.format('line')}, '```')::int f from l),
b as (select *, coalesce(sum(f) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) before from f),
k as (select *, case when f = 1 or before % 2 = 1 then 'code' when s = '' then 'blank' when regexp_matches(s, '^#{{1,6}}\s+\S') then 'title' when {_TABLE.format('s')} then 'table' else 'text' end kind, case when f = 1 or before % 2 = 1 then before // 2 end fence_no from b),
n as (select *, coalesce(kind <> lag(kind) over w or kind = 'title' or (kind = 'code' and fence_no <> lag(fence_no) over w), true)::int new from k window w as (partition by doc_id order by pos)),
i as (select *, sum(new) over (partition by doc_id order by pos) island from n)
select doc_id, min(pos) pos, kind, case when kind = 'title' then length(regexp_extract(min(s), '^(#+)', 1))::int end as level, case when kind = 'title' then {_STRIP.format(r"regexp_replace(min(s), '^#+\s+', '')")} else string_agg(line, chr(10) order by pos) end element
from i where kind <> 'blank' group by doc_id, island, kind"""


@query
def md_sections(spark: SparkSession, d: str) -> DataFrame:
    return K.heading_paths(docs(spark, d))


SQL["md_sections"] = f"""with t as (select doc_id, pos, level, element from ({SQL['md_elements']}) where kind = 'title'),
live as (select a.doc_id, a.pos, a.level, a.element heading, b.pos p2, b.element e2 from t a join t b on a.doc_id = b.doc_id and b.pos <= a.pos and (b.pos = a.pos or b.level < a.level)
  and not exists (select 1 from t c where c.doc_id = a.doc_id and c.pos > b.pos and c.pos <= a.pos and c.level <= b.level))
select doc_id, pos, level, heading, '/' || string_agg(e2, '/' order by p2) || '/' header_path from live group by all"""


@query
def heading_chain(spark: SparkSession, d: str) -> DataFrame:
    return K.heading_chains(docs(spark, d))


SQL["heading_chain"] = rf"""with l as (select doc_id, unnest(range(len(s)))::int line_no, unnest(s) line from (select doc_id, string_split(text, chr(10)) s from documents)),
h as (select doc_id, line_no, length(regexp_extract({_STRIP.format('line')}, '^(#+)', 1)) lv, {_STRIP.format("regexp_replace(" + _STRIP.format('line') + r", '^#+\s+', '')")} heading from l where regexp_matches({_STRIP.format('line')}, '^#{{1,6}}\s+\S'))
select a.doc_id, a.line_no, a.heading, coalesce(list(b.heading order by b.line_no) filter (where b.heading is not null), []) chain from h a left join h b on a.doc_id = b.doc_id and b.line_no < a.line_no and b.lv < a.lv group by a.doc_id, a.line_no, a.heading"""


@query
def md_chunk(spark: SparkSession, d: str) -> DataFrame:
    return K.markdown_chunks(docs(spark, d))


@query
def chunk_images(spark: SparkSession, d: str) -> DataFrame:
    """Images that each line chunk refers to."""
    c = chunk_lines(spark, d)
    paths = F.regexp_extract_all("chunk", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    return c.select("doc_id", "chunk_index", F.explode(F.array_distinct(paths)).alias("path"))


SQL["chunk_images"] = rf"select doc_id, chunk_index, unnest(list_distinct(regexp_extract_all(chunk, '!\[[^\]]*\]\(([^)]+)\)', 1))) path from ({SQL['chunk_lines']})"


@query
def chunk_heading_ctx(spark: SparkSession, d: str) -> DataFrame:
    """The heading above each sentence chunk: its line is found by the chunk's first 50 characters."""
    c = chunk_sentence(spark, d).join(docs(spark, d), "doc_id")
    head = F.expr("locate(substring(chunk, 1, 50), text)")
    line = F.size(F.split(F.substring("text", F.lit(1), head - 1), "\n")) - 1
    placed = c.where(head > 0).select("doc_id", "chunk_index", line.alias("line_no"))
    h = K.heading_chains(docs(spark, d)).select("doc_id", F.col("line_no").alias("h"), "heading")
    best = placed.join(h, "doc_id").where("h <= line_no").groupBy("doc_id", "chunk_index").agg(F.max_by("heading", "h").alias("heading"))
    return placed.join(best, ["doc_id", "chunk_index"], "left").select("doc_id", "chunk_index", "line_no", "heading")


SQL["chunk_heading_ctx"] = f"""with p as (select doc_id, chunk_index, (len(string_split(substring(text, 1, instr(text, substring(chunk, 1, 50)) - 1), chr(10))) - 1)::int line_no from ({SQL['chunk_sentence']}) join documents using (doc_id) where instr(text, substring(chunk, 1, 50)) > 0),
h as ({SQL['heading_chain']})
select p.doc_id, p.chunk_index, p.line_no, max_by(h.heading, h.line_no) heading from p left join h on h.doc_id = p.doc_id and h.line_no <= p.line_no group by all"""


@query
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    return K.semantic_chunks(docs(spark, d))


@query
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Fenced blocks of all documents, with their language."""
    return Code.code_blocks(docs(spark, d)).select("doc_id", "pos", "language", "lines")


SQL["code_blocks"] = rf"""select doc_id, pos, nullif(lower(regexp_extract(element, '\A\s*```(\w*)', 1)), '') as language, case when body = '' then 0 else len(string_split(body, chr(10))) end::int as lines from (
select *, regexp_replace(regexp_replace(element, '\A[^\n]*(\n|\z)', ''), '\n?[ \t]*```[^\n]*\z', '') body from ({SQL['md_elements']}) where kind = 'code')"""
