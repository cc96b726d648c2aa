"""Queries of document transforms and text statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ranks import numbered_within
from ..functions.text import estimated_tokens, matches
from ..operators import cleaning as C
from ..session import read
from ..sources.files import SUPPORTED

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def scans(spark: SparkSession, d: str) -> DataFrame:
    """Converted files, each once."""
    return read(spark, d, "pdf_conversions").where("markdown_content is not null").select("file_id", F.col("markdown_content").alias("text")).groupBy("file_id").agg(F.min("text").alias("text"))


_SCANS = "(select file_id, min(markdown_content) as text from pdf_conversions where markdown_content is not null group by file_id)"


@query
def src_documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text", "source", F.length("text").cast("long").alias("chars"))


SQL["src_documents"] = "select doc_id, text, source, length(text) chars from documents"


@query
def src_is_supported(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.substring_index("source_file", "/", -1))
    ext = F.regexp_extract(name, r"[^/](\.[^.]+)$", 1)
    return read(spark, d, "kb_nodes").where("source_file is not null").select("source_file").distinct().select("source_file", ext.alias("ext"), ext.isin(*SUPPORTED).alias("supported"))


SQL["src_is_supported"] = f"select source_file, ext, ext in ({', '.join(map(repr, SUPPORTED))}) supported from (select distinct source_file, regexp_extract(lower(regexp_extract(source_file, '[^/]*$')), '[^/](\\.[^.]+)$', 1) ext from kb_nodes where source_file is not null)"


@query
def fn_parse_pages(spark: SparkSession, d: str) -> DataFrame:
    """Zero-based page numbers of page lists such as 1-5,10; parts that are no numbers give none."""
    part = F.col("part")
    low, high = F.expr("try_cast(split_part(part, '-', 1) as int)"), F.expr("try_cast(split_part(part, '-', -1) as int)")
    rows = read(spark, d, "pdf_conversions").select("file_id", "pages").distinct().select("file_id", F.explode(F.split("pages", ",")).alias("part")).withColumn("part", F.trim(part))
    return rows.withColumn("low", low).withColumn("high", high).where("low <= high").select("file_id", F.explode(F.sequence(F.col("low") - 1, F.col("high") - 1)).alias("page"))


SQL["fn_parse_pages"] = "select file_id, unnest(range(low - 1, high))::int page from (select file_id, try_cast(split_part(trim(p), '-', 1) as int) low, try_cast(split_part(trim(p), '-', -1) as int) high from (select distinct file_id, pages, unnest(string_split(pages, ',')) p from (select distinct file_id, pages from pdf_conversions))) where low <= high"


@query
def hf_detect(spark: SparkSession, d: str) -> DataFrame:
    return C.repeated_lines(scans(spark, d), "file_id")


_STRIP = r"regexp_replace({0}, '^[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+$', '', 'g')"
_TABLE = r"(regexp_matches({0}, '^[|\s\-:]+$') or regexp_matches({0}, '^\|.+\|$'))"
SQL["hf_detect"] = f"select file_id, line, count(*) n from (select file_id, {_STRIP.format('l')} line from (select file_id, unnest(string_split(text, chr(10))) l from {_SCANS})) where length(line) between 5 and 100 and not {_TABLE.format('line')} group by all having count(*) >= 3"


@query
def hf_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.without_repeated_lines(scans(spark, d), "file_id")


SQL["hf_filter"] = f"""with marks as (select file_id, list(line) marks from ({SQL['hf_detect']}) group by file_id)
select file_id, case when marks is null then text else {_STRIP.format("regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: " + _TABLE.format(_STRIP.format('x')) + " or not list_bool_or(list_transform(marks, lambda m: starts_with(" + _STRIP.format('x') + ", m) or ends_with(" + _STRIP.format('x') + r", m)))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} end as text
from {_SCANS} left join marks using (file_id)"""


@query
def md_strip_headings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", C.strip_heading_marks(F.col("text")).alias("text"))


_NUMBERED = r"^(#+)\s*(?:\*{2})?(\d+(?:\.\d+)*)(?:\*{2})?\s+"
_LINES = "(select doc_id, list_transform(string_split(text, chr(10)), lambda x: {0}) l from documents)"
SQL["md_strip_headings"] = "select doc_id, array_to_string(l, chr(10)) as text from " + _LINES.format(rf"case when regexp_matches(x, '^#+\s+(.+)$') and not regexp_matches(x, '{_NUMBERED}') then " + _STRIP.format(r"regexp_extract(x, '^#+\s+(.+)$', 1)") + " else x end")


@query
def md_fix_headings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", C.fix_heading_levels(F.col("text")).alias("text"))


SQL["md_fix_headings"] = "select doc_id, array_to_string(l, chr(10)) as text from " + _LINES.format(
    rf"case when regexp_matches(x, '{_NUMBERED}') then repeat('#', least(len(string_split(regexp_extract(x, '{_NUMBERED}', 2), '.')), 6)) || ' ' || regexp_extract(x, '{_NUMBERED}', 2) || ' ' || " + _STRIP.format(rf"replace(regexp_replace(x, '{_NUMBERED}', ''), '**', '')") + " else x end"
)


@query
def md_images(spark: SparkSession, d: str) -> DataFrame:
    return C.images(read(spark, d, "documents"))


SQL["md_images"] = r"""select doc_id, n::int n, alt_text, path, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') image_id from (
select doc_id, unnest(range(len(a))) n, unnest(a) alt_text, unnest(p) path from (select doc_id, regexp_extract_all(text, '!\[([^\]]*)\]\(([^)]+)\)', 1) a, regexp_extract_all(text, '!\[([^\]]*)\]\(([^)]+)\)', 2) p from documents))"""


@query
def md_extract_tables(spark: SparkSession, d: str) -> DataFrame:
    return C.table_islands(scans(spark, d), "file_id")


SQL["md_extract_tables"] = f"""select file_id, start_line::int start_line, end_line::int end_line, rows from (
select file_id, island, min(pos) start_line, max(pos) end_line, sum(1 - rule)::bigint as rows, min(case when rule = 1 then pos end) rule_line from (
select *, pos - row_number() over (partition by file_id order by pos) island, (regexp_matches(line, '^[|\\s\\-:]+$') and contains(line, '-'))::int rule from (
select file_id, pos, {_STRIP.format('l')} line from (select file_id, unnest(range(len(s))) pos, unnest(s) l from (select file_id, string_split(text, chr(10)) s from {_SCANS})))
where {_TABLE.format('line')}) group by file_id, island) where rule_line = start_line + 1"""


@query
def md_table_titles(spark: SparkSession, d: str) -> DataFrame:
    """Tables with the title line above them, and the link that stands for each in an index."""
    return C.table_titles(scans(spark, d), "file_id")


_LINES = f"(select file_id, pos, {_STRIP.format('l')} line from (select file_id, unnest(range(len(s)))::int pos, unnest(s) l from (select file_id, string_split(text, chr(10)) s from {_SCANS})))"
SQL["md_table_titles"] = rf"""with t as (select *, row_number() over (partition by file_id order by start_line)::int table_no from ({SQL['md_extract_tables']})),
m as (select t.file_id, table_no, max_by(line, pos) line from t join {_LINES} l on l.file_id = t.file_id and pos between start_line - 9 and start_line - 1 where regexp_matches(line, '{C.TITLE_STOPS}') group by all),
n as (select file_id, table_no, rtrim(regexp_replace(line, '{C.TABLE_TITLE}', '表  ')) title from m where regexp_matches(line, '{C.TABLE_TITLE}'))
select t.file_id, t.table_no, t.start_line, coalesce(title, '') title, '[' || coalesce(title, '') || '](tables/table_' || t.table_no || '_' || substring(regexp_replace(coalesce(title, ''), '[^\p{{L}}\p{{N}}_-]', '_', 'g'), 1, 50) || '.md)' link from t left join n using (file_id, table_no)"""


@query
def doc_title(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", C.title(F.col("text")).alias("title"))


_FIRST = _STRIP.format("x")
SQL["doc_title"] = rf"""select doc_id, case when regexp_extract(text, '\A#\s+([^\n]+)\z', 1) <> '' then {_STRIP.format("regexp_extract(text, '\\A#\\s+([^\\n]+)\\z', 1)".replace(chr(92)*2, chr(92)))}
else substring(list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 5), lambda x: {_FIRST}), lambda x: length(x) > 10 and not starts_with(x, '#'))[1], 1, 50) end title from documents"""


@query
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", C.mostly_chinese(F.col("text")).alias("lang"))


SQL["lang_detect"] = "select doc_id, case when length(regexp_replace(substring(text, 1, 500), '[^一-鿿]', '', 'g')) > 0.3 * length(substring(text, 1, 500)) then 'zh' else 'en' end lang from documents"


@query
def est_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "kb_nodes").select("node_id", estimated_tokens(F.col("text")).cast("long").alias("tokens")).distinct()


SQL["est_tokens"] = "select distinct node_id, length(text) // 4 tokens from kb_nodes"


@query
def embed_prep(spark: SparkSession, d: str) -> DataFrame:
    """Text for embedding: line ends as blanks; blank texts get a zero vector."""
    t = F.regexp_replace("text", "\n", " ")
    blank = F.coalesce(F.trim(t) == "", F.lit(True))
    return read(spark, d, "documents").select("doc_id", t.alias("prepared"), F.when(blank, F.array_repeat(F.lit(0.0), 8)).alias("vector"))


SQL["embed_prep"] = "select doc_id, replace(text, chr(10), ' ') prepared, case when coalesce(trim(replace(text, chr(10), ' ')) = '', true) then [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::double[] end vector from documents"


@query
def sha256_docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


SQL["sha256_docs"] = "select doc_id, sha256(text) hash from documents"


@query
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of chunk lengths, all at once; distinct documents are 1 at least."""
    n = read(spark, d, "kb_nodes").where("text is not null").select(F.length("text").alias("len"), "ref_doc_id")
    return n.agg(
        F.count("*").alias("total_chunks"), F.greatest(F.countDistinct("ref_doc_id"), F.lit(1)).alias("total_documents"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_chars"),
        F.round(F.avg("len"), 6).alias("avg_length"), F.min("len").alias("min_length"), F.max("len").alias("max_length"), F.round(F.coalesce(F.stddev_samp("len"), F.lit(0.0)), 6).alias("std_length"),
        F.median("len").alias("median_length"), F.round(F.count("*") / F.greatest(F.countDistinct("ref_doc_id"), F.lit(1)), 6).alias("chunks_per_doc"),
    )


SQL["chunk_stats"] = "select count(*) total_chunks, greatest(count(distinct ref_doc_id), 1) total_documents, coalesce(sum(l), 0)::bigint total_chars, round(avg(l), 6) avg_length, min(l)::int min_length, max(l)::int max_length, round(coalesce(stddev_samp(l), 0), 6) std_length, median(l) median_length, round(count(*) / greatest(count(distinct ref_doc_id), 1), 6) chunks_per_doc from (select length(text) l, ref_doc_id from kb_nodes where text is not null)"

# Upper bounds of chunk length buckets.
BUCKETS = ((100, "<100"), (200, "100-200"), (500, "200-500"), (1000, "500-1000"), (2000, "1000-2000"))


@query
def length_hist(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    bucket = F.when(n < BUCKETS[0][0], BUCKETS[0][1])
    for bound, name in BUCKETS[1:]:
        bucket = bucket.when(n < bound, name)
    return read(spark, d, "kb_nodes").where("text is not null").groupBy(bucket.otherwise(">2000").alias("bucket")).agg(F.count("*").alias("n"))


SQL["length_hist"] = "select case " + " ".join(f"when length(text) < {b} then '{n}'" for b, n in BUCKETS) + " else '>2000' end bucket, count(*) n from kb_nodes where text is not null group by 1"


@query
def info_density(spark: SparkSession, d: str) -> DataFrame:
    """Share of characters that are neither blank nor line end, per source."""
    solid, every = F.sum(F.length(F.translate("text", " \n", ""))), F.sum(F.length("text"))
    return read(spark, d, "kb_nodes").groupBy("source_file").agg(F.when(every > 0, F.round(solid / every, 6)).alias("density"))


SQL["info_density"] = "select source_file, case when sum(length(text)) > 0 then round(sum(length(replace(replace(text, ' ', ''), chr(10), ''))) / sum(length(text)), 6) end density from kb_nodes group by 1"


@query
def quality_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample stratified by length: of every source's chunks, in order of length, one in ten from the first on."""
    n = read(spark, d, "kb_nodes").where("text is not null and source_file is not null").groupBy("node_id", "source_file").agg(F.max(F.length("text")).alias("len"))
    return numbered_within(n, "source_file", F.col("len"), ["node_id"], "place").where("(place - 1) % 10 = 0").select("source_file", "node_id", "len")


SQL["quality_sample"] = "select source_file, node_id, len::int len from (select *, row_number() over (partition by source_file order by len, node_id) p from (select node_id, source_file, max(length(text)) len from kb_nodes where text is not null and source_file is not null group by all)) where (p - 1) % 10 = 0"


@query
def pipeline_stats(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "kb_nodes").join(F.broadcast(read(spark, d, "source_files")), "source_file", "left")  # a fixed table
    return n.groupBy("collection").agg(F.count("*").alias("nodes"), F.countDistinct("node_id").alias("distinct_nodes"), F.countDistinct("source_file").alias("files"), F.count("deleted_at").alias("deleted"))


SQL["pipeline_stats"] = "select collection, count(*) nodes, count(distinct node_id) distinct_nodes, count(distinct source_file) files, count(deleted_at) deleted from kb_nodes left join source_files using (source_file) group by 1"

# Words that are no keywords.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare",
    "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "and", "but",
    "if", "or", "because", "until", "while", "although", "though", "这", "那", "是", "有", "和", "的", "了", "在", "不", "也", "就", "都", "可以", "会", "要", "能", "一个", "这个", "那个", "什么", "怎么", "如何",
)


def keywords(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, word, freq, place: the most frequent words of each text, ties by first appearance."""
    words = docs.select("doc_id", F.posexplode(matches(F.lower("text"), "[a-zA-Z]+|[一-鿿]+")).alias("pos", "word")).where(F.length("word") > 2).where(~F.col("word").isin(*STOP_WORDS))
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("freq"), F.min("pos").alias("first"))
    return counted.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("freq"), "first"))).where(F.col("place") <= k).select("doc_id", "word", "freq", "place")


@query
def kw_top5(spark: SparkSession, d: str) -> DataFrame:
    return keywords(read(spark, d, "documents"))


SQL["kw_top5"] = f"""select doc_id, word, freq, place::int place from (select *, row_number() over (partition by doc_id order by freq desc, f) place from (select doc_id, word, count(*) freq, min(pos) f from (
select doc_id, unnest(range(len(w))) pos, unnest(w) word from (select doc_id, regexp_extract_all(lower(text), '[a-zA-Z]+|[一-鿿]+') w from documents)) where length(word) > 2 and word not in ({', '.join(map(repr, STOP_WORDS))}) group by all)) where place <= 5"""


@query
def gen_query(spark: SparkSession, d: str) -> DataFrame:
    """A question about each text from its two main keywords, else from its first sentence."""
    docs = read(spark, d, "documents").where("text is not null")
    top = keywords(docs, 2).groupBy("doc_id").agg(F.max(F.when(F.col("place") == 1, F.col("word"))).alias("w1"), F.max(F.when(F.col("place") == 2, F.col("word"))).alias("w2"))
    first = F.substring(F.substring_index(F.when(F.contains("text", F.lit(". ")), F.col("text")).otherwise(F.substring("text", 1, 100)), ". ", 1), 1, 50)
    # The three forms of a question.
    q = F.when(F.col("w2").isNotNull(), F.concat(F.lit("What is the relationship between "), "w1", F.lit(" and "), "w2", F.lit("?"))).when(F.col("w1").isNotNull(), F.concat(F.lit("What is "), "w1", F.lit("?"))).otherwise(F.concat(F.lit("What is discussed in: "), first, F.lit("?")))
    return docs.select("doc_id", "text").join(top, "doc_id", "left").select("doc_id", q.alias("question"))


SQL["gen_query"] = f"""select doc_id, case when w2 is not null then 'What is the relationship between ' || w1 || ' and ' || w2 || '?' when w1 is not null then 'What is ' || w1 || '?'
else 'What is discussed in: ' || substring(split_part(case when contains(text, '. ') then text else substring(text, 1, 100) end, '. ', 1), 1, 50) || '?' end question
from documents left join (select doc_id, max(case when place = 1 then word end) w1, max(case when place = 2 then word end) w2 from ({SQL['kw_top5']}) group by 1) using (doc_id) where text is not null"""
