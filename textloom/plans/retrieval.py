"""Retrieval queries. The query set of text search is every evaluation item whose id is divisible by 50, that of vector
and hybrid search every record whose id is; each is held against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD
from ..operators import retrieval as R
from ..session import read

QUERIES = {}
SQL = {}
K = 10


def query(f):
    QUERIES[f.__name__] = f
    return f


def asked(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "eval_items").where("item_id % 50 = 0 and trim(query) <> ''")
    return items.groupBy(F.col("query").alias("query_text")).agg(F.min("item_id").alias("query_id"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")


def titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("doc_id % 50 = 0 and trim(title) <> ''").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query_text"))


def title_vectors(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).join(vector_queries(spark, d), "query_id").select("query_id", "embedding")


def lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return R.dense_topk(title_vectors(spark, d), vectors(spark, d), K), R.bm25(titles(spark, d), documents(spark, d), K)


_ASKED = "(select query query_text, min(item_id) query_id from eval_items where item_id % 50 = 0 and trim(query) <> '' group by query)"
_TITLES = "(select doc_id query_id, title query_text from documents where doc_id % 50 = 0 and trim(title) <> '')"


def _top(scored: str, k: int = K) -> str:
    return f"select query_id, doc_id, score, rank::int rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from ({scored})) where rank <= {k}"


def _bm25(queries: str) -> str:
    return rf"""
with wanted as (select distinct query_id, unnest(list_distinct(regexp_extract_all(lower(query_text), '{WORD}'))) term from {queries}),
sized as (select doc_id, regexp_extract_all(lower(text), '{WORD}') t from documents),
st as (select count(*) n, avg(coalesce(len(t), 0)) a from sized),
tf as (select doc_id, coalesce(len(t), 0) dl, term, count(*) tf from (select doc_id, t, unnest(t) term from sized) group by all),
df as (select term, count(*) df from tf group by term)
""" + _top("""select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) score
from wanted join tf using (term) join df using (term), st group by query_id, doc_id""")


def _dense(queries: str, score: str) -> str:
    return _top(f"select q.vec_id query_id, e.vec_id doc_id, round({score}, 6) score from {queries} q, embeddings e")


_COS = "list_cosine_similarity(q.embedding::double[], e.embedding::double[])"
_DOT = "list_inner_product(q.embedding::double[], e.embedding::double[])"
_L2 = "0 - list_distance(q.embedding::double[], e.embedding::double[])"
_VQ = "(select * from embeddings where vec_id % 50 = 0)"
_TQ = f"(select e.* from embeddings e join {_TITLES} t on t.query_id = e.vec_id)"


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(asked(spark, d), documents(spark, d), K)


SQL["bm25_topk"] = _bm25(_ASKED)


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_topk(vector_queries(spark, d), vectors(spark, d), K)


SQL["dense_topk"] = _dense(_VQ, _COS)


@query
def dense_topk_dot(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_topk(vector_queries(spark, d), vectors(spark, d), K, "dot")


SQL["dense_topk_dot"] = _dense(_VQ, _DOT)


@query
def dense_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_topk(vector_queries(spark, d), vectors(spark, d), K, "l2")


SQL["dense_topk_l2"] = _dense(_VQ, _L2)


@query
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return R.rrf([*lists(spark, d)], K)


_LISTS = f"dense as ({_dense(_TQ, _COS)}), sparse as ({_bm25(_TITLES)})"
SQL["hybrid_rrf"] = f"with {_LISTS} " + _top("select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) score from (select query_id, doc_id, rank from dense union all select query_id, doc_id, rank from sparse) group by all")


@query
def hybrid_alpha(spark: SparkSession, d: str) -> DataFrame:
    return R.weighted_fusion(*lists(spark, d), K)


def _minmax(t: str) -> str:
    return f"select query_id, doc_id, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end s from {t} window w as (partition by query_id)"


SQL["hybrid_alpha"] = f"with {_LISTS}, d as ({_minmax('dense')}), s as ({_minmax('sparse')}) " + _top("select query_id, doc_id, round(0.5 * coalesce(d.s, 0) + 0.5 * coalesce(s.s, 0), 6) score from d full join s using (query_id, doc_id)")


def variants(asked: DataFrame) -> DataFrame:
    """query_id, variant_no, query_text: the query, its first half of words, its last half; without repetition."""
    words = F.split("query_text", " ")
    half = F.ceil(F.size(words) / 2).cast("int")
    every = F.array(F.col("query_text"), F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "))
    rows = asked.select("query_id", F.posexplode(every).alias("variant_no", "query_text")).where("trim(query_text) <> ''")
    return R.first_seen(rows, ["query_id", "query_text"], ["variant_no"])


@query
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    return variants(asked(spark, d))


_VARIANTS = f"""(select query_id, min(variant_no)::int variant_no, query_text from (
  select query_id, 0 variant_no, query_text from {_ASKED}
  union all select query_id, 1, array_to_string(list_slice(w, 1, ceil(len(w) / 2)::int), ' ') from (select query_id, string_split(query_text, ' ') w from {_ASKED})
  union all select query_id, 2, array_to_string(list_slice(w, ceil(len(w) / 2)::int + 1, len(w)), ' ') from (select query_id, string_split(query_text, ' ') w from {_ASKED}))
  where trim(query_text) <> '' group by query_id, query_text)"""
SQL["query_variants"] = f"select * from {_VARIANTS}"


def fanned_out(spark: SparkSession, d: str, k: int = 2 * K) -> DataFrame:
    v = variants(asked(spark, d))
    key = v.withColumn("query_id", F.col("query_id") * 4 + F.col("variant_no"))
    return R.bm25(key, documents(spark, d), k).select(F.floor(F.col("query_id") / 4).alias("query_id"), F.pmod("query_id", F.lit(4)).cast("int").alias("variant_no"), "doc_id", "score", "rank")


@query
def multi_query_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Every variant's own ranked list."""
    return fanned_out(spark, d)


_FAN = f"select query_id.query_id query_id, query_id.variant_no variant_no, doc_id, score, rank from ({_bm25(f'(select (struct_pack(query_id := query_id, variant_no := variant_no)) query_id, query_text from {_VARIANTS})').replace(f'rank <= {K}', f'rank <= {2 * K}')})"
SQL["multi_query_fanout"] = _FAN


@query
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """Of the variants' lists each document once, where it came first: by variant, then rank."""
    return R.first_seen(fanned_out(spark, d), ["query_id", "doc_id"], ["variant_no", "rank"])


SQL["dedup_first"] = f"select * exclude (n) from (select *, row_number() over (partition by query_id, doc_id order by variant_no, rank) n from ({_FAN})) where n = 1"


def searched(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    """Fan-out, first occurrences, reranking by word overlap with the query, cut to k; with source and preview."""
    found = R.first_seen(fanned_out(spark, d), ["query_id", "doc_id"], ["variant_no", "rank"]).select("query_id", "doc_id", "variant_no", F.col("rank").alias("found_rank"))
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    scored = found.join(docs, "doc_id").join(asked(spark, d), "query_id").withColumn("score", R.overlap_score(F.col("query_text"), F.col("text")))
    return R.top_k(scored, k).select("query_id", "doc_id", "score", "rank", F.coalesce("source", F.lit("unknown")).alias("source"), F.substring("text", 1, 200).alias("preview"))


@query
def search(spark: SparkSession, d: str) -> DataFrame:
    return searched(spark, d)


_JACCARD = """case when len(list_distinct(list_concat(a, b))) = 0 then 0.0 else round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) end"""
_SEARCH = f"""select query_id, doc_id, score, rank::int rank, coalesce(source, 'unknown') source, substring(text, 1, 200) preview from (
select *, row_number() over (partition by query_id order by score desc, doc_id) rank from (
select query_id, doc_id, source, text, {_JACCARD} score from (
  select f.query_id, f.doc_id, source, text, list_distinct(regexp_extract_all(lower(query_text), '{WORD}')) a, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{WORD}')) b
  from ({SQL['dedup_first']}) f join documents using (doc_id) join {_ASKED} q on q.query_id = f.query_id))) where rank <= {K}"""
SQL["search"] = _SEARCH


@query
def search_files(spark: SparkSession, d: str) -> DataFrame:
    """Per query: its sources, with the number of results and the best rank of each."""
    return searched(spark, d).groupBy("query_id", "source").agg(F.count("*").alias("chunks"), F.min("rank").alias("first_rank"))


SQL["search_files"] = f"select query_id, source, count(*) chunks, min(rank) first_rank from ({_SEARCH}) group by all"


@query
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    """BM25 results reranked by word overlap, the best 5."""
    base = R.bm25(asked(spark, d), documents(spark, d), 2 * K).select("query_id", "doc_id")
    scored = base.join(documents(spark, d), "doc_id").join(asked(spark, d), "query_id").withColumn("score", R.overlap_score(F.col("query_text"), F.col("text")))
    return R.top_k(scored, 5).select("query_id", "doc_id", "score", "rank")


SQL["rerank_overlap"] = f"""select query_id, doc_id, score, rank::int rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from (
select query_id, doc_id, {_JACCARD} score from (select f.query_id, f.doc_id, list_distinct(regexp_extract_all(lower(query_text), '{WORD}')) a, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{WORD}')) b
from ({_bm25(_ASKED).replace(f'rank <= {K}', f'rank <= {2 * K}')}) f join documents using (doc_id) join {_ASKED} q on q.query_id = f.query_id))) where rank <= 5"""


@query
def rerank_disabled(spark: SparkSession, d: str) -> DataFrame:
    """Without a reranker: the first 5 results in their order."""
    return R.bm25(asked(spark, d), documents(spark, d), K).where("rank <= 5")


SQL["rerank_disabled"] = f"select * from ({_bm25(_ASKED)}) where rank <= 5"


@query
def filter_results(spark: SparkSession, d: str) -> DataFrame:
    """The best 10 BM25 results with a score of 5 at least from sources that hold 'runbooks'."""
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    found = R.bm25(asked(spark, d), docs, K, only=docs.where(F.contains(F.lower("source"), F.lit("runbooks")))).drop("rank").join(docs.select("doc_id", "source"), "doc_id")
    return R.filter_results(found, "RUNBOOKS", 5.0, None, K).select("query_id", "doc_id", "score", "rank", "source")


SQL["filter_results"] = f"select query_id, doc_id, score, rank::int rank, source from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from (select f.* exclude (rank), source from ({_bm25(_ASKED).replace(f'where rank <= {K}', '')}) f join documents using (doc_id) where score >= 5 and contains(lower(source), 'runbooks'))) where rank <= {K}"


@query
def tool_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """The first 3 of each variant's list, each document once, 10 at most."""
    rows = R.first_seen(fanned_out(spark, d).where("rank <= 3"), ["query_id", "doc_id"], ["variant_no", "rank"])
    from pyspark.sql.window import Window as W

    place = F.row_number().over(W.partitionBy("query_id").orderBy("variant_no", "rank"))
    return rows.withColumn("place", place).where("place <= 10").select("query_id", "doc_id", "place")


SQL["tool_multi_query"] = f"""select query_id, doc_id, place::int place from (select *, row_number() over (partition by query_id order by variant_no, rank) place from (
select * exclude (n) from (select *, row_number() over (partition by query_id, doc_id order by variant_no, rank) n from ({_FAN}) where rank <= 3) where n = 1)) where place <= 10"""


@query
def format_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Results as lines: rank, score with 3 decimals, base name of the source, 300 characters of text."""
    r = R.bm25(asked(spark, d), documents(spark, d), 5).join(read(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.format_string("%.3f", "score"), F.lit(") "), F.coalesce(F.substring_index("source", "/", -1), F.lit("unknown")), F.lit(": "), F.substring("text", 1, 300))
    return r.select("query_id", "rank", line.alias("line"))


SQL["format_nodes"] = f"select query_id, rank, '[' || rank || '] (' || printf('%.3f', score) || ') ' || coalesce(regexp_extract(source, '[^/]*$'), 'unknown') || ': ' || substring(text, 1, 300) line from ({_bm25(_ASKED)}) join documents using (doc_id) where rank <= 5"


_IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"


def image_results(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """query_id, doc_id, score, position, path: images of the k best texts with images."""
    shown = documents(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_IMAGE), F.lit(1))).alias("position", "path"))
    return R.bm25(asked(spark, d), documents(spark, d), k, only=shown).join(shown, "doc_id").select("query_id", "doc_id", "score", "position", "path")


@query
def dedup_images(spark: SparkSession, d: str) -> DataFrame:
    """Images of the texts a query found, each path once, with the best score of a text that shows it."""
    best = image_results(spark, d).groupBy("query_id", "path").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"))).alias("m"))
    return best.select("query_id", "path", "m.score", (-F.col("m.d")).alias("doc_id"))


_IMAGES = rf"""(select query_id, doc_id, score, unnest(paths) path, generate_subscripts(paths, 1) - 1 as position from (
select *, row_number() over (partition by query_id order by score desc, doc_id) n from (select f.query_id, f.doc_id, f.score, regexp_extract_all(text, '{_IMAGE}', 1) paths from ({_bm25(_ASKED).replace(f'where rank <= {K}', '')}) f join documents using (doc_id)) where len(paths) > 0) where n <= 50)"""
SQL["dedup_images"] = f"select query_id, path, score, doc_id from (select *, row_number() over (partition by query_id, path order by score desc, doc_id) n from (select distinct query_id, doc_id, score, path from {_IMAGES})) where n = 1"


@query
def table_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Tables that scanned files name, with the number of files that name the same; absolute and climbing paths are refused."""
    t = read(spark, d, "pdf_conversions").select("file_id", F.explode("table_files").alias("path")).distinct().where("path is not null and path not like '/%' and not contains(path, '..')")
    return t.join(t.groupBy("path").agg(F.count("*").alias("files")), "path").select("file_id", "path", F.substring_index("path", "/", -1).alias("name"), "files")


SQL["table_lookup"] = "select file_id, path, regexp_extract(path, '[^/]*$') as name, count(*) over (partition by path) files from (select distinct file_id, unnest(table_files) path from pdf_conversions) where path is not null and path not like '/%' and not contains(path, '..')"


@query
def rerank_remap(spark: SparkSession, d: str) -> DataFrame:
    """A scorer's answer in JSON, positions with scores in its own order, mapped back to the results. The scorer here is word overlap."""
    base = R.bm25(asked(spark, d), documents(spark, d), 5).select("query_id", "doc_id", (F.col("rank") - 1).alias("index"))
    judged = base.join(documents(spark, d), "doc_id").join(asked(spark, d), "query_id").select("query_id", F.struct("index", R.overlap_score(F.col("query_text"), F.col("text")).alias("relevance_score")).alias("r"))
    answer = judged.groupBy("query_id").agg(F.to_json(F.struct(F.struct(F.sort_array(F.collect_list("r"), asc=False).alias("results")).alias("output"))).alias("answer"))
    read_back = F.from_json("answer", "output struct<results: array<struct<index: int, relevance_score: double>>>")["output"]["results"]
    scored = answer.select("query_id", F.inline(read_back)).join(base, ["query_id", "index"]).withColumnRenamed("relevance_score", "score")
    return R.top_k(scored, 3).select("query_id", "doc_id", "score", "rank")


SQL["rerank_remap"] = f"""select query_id, doc_id, score, rank::int rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from (
select query_id, doc_id, {_JACCARD} score from (select f.query_id, f.doc_id, list_distinct(regexp_extract_all(lower(query_text), '{WORD}')) a, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{WORD}')) b
from ({_bm25(_ASKED).replace(f'rank <= {K}', 'rank <= 5')}) f join documents using (doc_id) join {_ASKED} q on q.query_id = f.query_id))) where rank <= 3"""


def by_mode(spark: SparkSession, d: str, mode: str | None) -> DataFrame:
    """Ranked lists for titles by retrieval mode: vector, sparse, or hybrid for any other name and for none."""
    dense, sparse = lists(spark, d)
    return {"vector": dense, "sparse": sparse}.get(mode, R.rrf([dense, sparse], K))


@query
def retrieve_modes(spark: SparkSession, d: str) -> DataFrame:
    """The three modes' lists, and how many of a mode's documents the hybrid list holds too."""
    rows = None
    for mode in ("vector", "sparse", None):
        part = by_mode(spark, d, mode).select("query_id", "doc_id", F.lit(mode or "hybrid").alias("mode"))
        rows = part if rows is None else rows.unionByName(part)
    both = rows.groupBy("query_id", "doc_id").agg(F.collect_set("mode").alias("modes"))
    return both.select("query_id", F.explode("modes").alias("mode"), F.array_contains("modes", "hybrid").cast("int").alias("kept")).groupBy("query_id", "mode").agg(F.count("*").alias("found"), F.sum("kept").alias("kept"))


SQL["retrieve_modes"] = f"""with {_LISTS}, hybrid as ({_top("select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) score from (select query_id, doc_id, rank from dense union all select query_id, doc_id, rank from sparse) group by all")}),
a as (select query_id, doc_id, 'vector' mode from dense union all select query_id, doc_id, 'sparse' from sparse union all select query_id, doc_id, 'hybrid' from hybrid)
select a.query_id, mode, count(*) found, count(h.doc_id) kept from a left join hybrid h on h.query_id = a.query_id and h.doc_id = a.doc_id group by all"""


@query
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """Feature-hash vectors of all documents: words by the first hex digits of their md5, 16 dimensions, length 1."""
    words = R.postings(documents(spark, d)).select("doc_id", F.pmod(F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("int"), F.lit(16)).alias("dim"), "tf")
    counted = words.groupBy("doc_id", "dim").agg(F.sum("tf").cast("double").alias("v"))
    norm = counted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.round(F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("norm"), 6))
    return norm.select("doc_id", vec.alias("embedding"))


SQL["hash_embed"] = f"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) t from documents),
c as (select doc_id, ('0x' || substring(md5(t), 1, 4))::int % 16 dim, count(*)::double v from w group by all),
n as (select doc_id, sqrt(sum(v * v)) n from c group by doc_id)
select doc_id, list(round(coalesce(v, 0) / n, 6) order by dim) embedding from (select doc_id, n, unnest(range(16)) dim from n) left join c using (doc_id, dim) group by doc_id"""
