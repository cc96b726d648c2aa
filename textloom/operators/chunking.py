"""Chunkers: one text in, numbered chunks out. Greedy ones fold over a text's pieces inside one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .cleaning import document_lines, is_table_line, strip

STRINGS = T.ArrayType(T.StringType())
SENTENCE_END = "(?<=[.!?])[ \t\r\n]+|(?<=[。！？])|\n+"


def _none() -> Column:
    return F.array().cast(STRINGS)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once; expressions inside a fold are not shared otherwise."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` words, each starting size - overlap words after the one before; none for blank texts."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    words = F.filter(F.split(text, "[ \t\r\n]+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.size(words) > 0, F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " "))).otherwise(_none())


def pack(pieces: Column, limit: int, glue: str, weigh=F.length, cost: int = 0) -> Column:
    """Pieces joined one after the other as long as their weights, with `cost` for each joint, stay within the limit."""
    state = F.struct(F.lit(None).cast("string").alias("cur"), F.lit(0).cast("long").alias("w"), _none().alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = s["w"] + weigh(x) + cost <= limit
        return (
            F.when(s["cur"].isNull(), F.struct(x.alias("cur"), weigh(x).cast("long").alias("w"), s["out"].alias("out")))
            .when(fits, F.struct(F.concat(s["cur"], F.lit(glue), x).alias("cur"), (s["w"] + weigh(x) + cost).cast("long").alias("w"), s["out"].alias("out")))
            .otherwise(F.struct(x.alias("cur"), weigh(x).cast("long").alias("w"), F.concat(s["out"], F.array(s["cur"])).alias("out")))
        )

    return F.aggregate(pieces, state, step, lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda x: x != "")


def sentence_chunks(text: Column, limit: int = 500) -> Column:
    """Whole sentences packed up to `limit` characters; a longer sentence is a chunk of its own."""
    return pack(sentences(text), limit, " ", cost=1)


def line_chunks(text: Column, limit: int = 128) -> Column:
    """Lines packed up to `limit` estimated tokens, a quarter of each line's characters."""
    return pack(F.split(text, "\n"), limit, "\n", lambda x: F.floor(F.length(x) / 4))


def chinese_chunks(text: Column, size: int = 512, overlap: int = 50, hard: int = 4000) -> Column:
    """Sentences ending in 。！？； or a line end, packed in characters; the next chunk begins with the last `overlap`
    characters of the one before; a sentence longer than `size` is cut into windows."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    parts = F.filter(F.transform(F.split(text, "(?<=[。！？；\n])(?![。！？；\n])"), strip), lambda x: x != "")
    width = min(size, hard)
    state = F.struct(F.lit("").alias("cur"), _none().alias("out"))

    def step(s: Column, x: Column) -> Column:
        kept = F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"])))
        starts = F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)), F.lit(width - overlap))
        cut = F.transform(starts, lambda i: F.substring(x, i, F.lit(width)))
        tail = F.when(s["cur"] == "", F.lit("")).otherwise(F.substring(s["cur"], F.greatest(F.length(s["cur"]) - overlap + 1, F.lit(1)), F.lit(overlap)))
        return (
            F.when(F.length(x) > size, F.struct(F.lit("").alias("cur"), F.concat(kept, cut).alias("out")))
            .when(F.length(s["cur"]) + F.length(x) <= size, F.struct(F.concat(s["cur"], x).alias("cur"), s["out"].alias("out")))
            .otherwise(F.struct(F.concat(tail, x).alias("cur"), kept.alias("out")))
        )

    return F.aggregate(parts, state, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))


def char_chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of `size` characters that end after the last line end, else the last blank, of their second half."""
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be smaller than half the size")
    n = F.length(text)
    turns = F.sequence(F.lit(0), F.ceil(n / (size // 2 - overlap)).cast("int") + 1)
    state = F.struct(F.lit(0).alias("start"), _none().alias("out"))

    def last(piece: Column, c: str) -> Column:
        return F.length(piece) - F.instr(F.reverse(piece), c)

    def ends(piece: Column, start: Column) -> Column:
        line, blank = last(piece, "\n"), last(piece, " ")
        has_line = (F.instr(piece, "\n") > 0) & (line > size // 2)
        has_blank = (F.instr(piece, " ") > 0) & (blank > size // 2)
        return F.when(start + size >= n, start + size).otherwise(start + F.when(has_line, line + 1).when(has_blank, blank + 1).otherwise(size))

    def taken(s: Column, end: Column, chunk: Column) -> Column:
        out = F.when(chunk == "", s["out"]).otherwise(F.concat(s["out"], F.array(chunk)))
        return F.struct(F.when(end - overlap > s["start"], end - overlap).otherwise(end).cast("int").alias("start"), out.alias("out"))

    def step(s: Column, _i: Column) -> Column:
        cut = _let(F.substring(text, s["start"] + 1, F.lit(size)), lambda piece: ends(piece, s["start"]))
        new = _let(cut, lambda end: _let(strip(F.substring(text, s["start"] + 1, end - s["start"])), lambda chunk: taken(s, end, chunk)))
        return F.when(s["start"] >= n, s).otherwise(new)

    return F.when(n <= size, F.array(text)).otherwise(F.aggregate(turns, state, step, lambda s: s["out"]))


def numbered(docs: DataFrame, chunks: Column, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, total_chunks, chunk of every chunk; texts without any give no row."""
    return docs.select(key, chunks.alias("c")).select(key, F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "chunk"))


def markdown_elements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, kind (title, code, table, text), level, element: neighbouring lines of one kind are one element.

    A line is code between fences, the fences included; blank lines outside code belong to nothing and end an element.
    """
    lines = document_lines(docs, key, text).withColumn("s", strip(F.col("line")))
    w = W.partitionBy(key).orderBy("pos")
    fence = F.col("s").startswith("```").cast("int")
    lines = lines.withColumn("f", fence).withColumn("before", F.coalesce(F.sum("f").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    code = (F.col("f") == 1) | (F.col("before") % 2 == 1)
    kind = F.when(code, "code").when(F.col("s") == "", "blank").when(F.col("s").rlike(r"^#{1,6}\s+\S"), "title").when(is_table_line(F.col("s")), "table").otherwise("text")
    lines = lines.withColumn("kind", kind).withColumn("fence_no", F.when(code, F.floor(F.col("before") / 2)))
    new = (F.col("kind") != F.lag("kind").over(w)) | (F.col("kind") == "title") | ((F.col("kind") == "code") & (F.col("fence_no") != F.lag("fence_no").over(w)))
    lines = lines.withColumn("island", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w)).where("kind <> 'blank'")
    merged = lines.groupBy(key, "island").agg(F.min("pos").alias("pos"), F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    first = strip(F.get("l", F.lit(0))["line"])
    return merged.select(key, "pos", "kind", F.when(F.col("kind") == "title", F.length(F.regexp_extract(first, "^(#+)", 1))).alias("level"), F.when(F.col("kind") == "title", strip(F.regexp_replace(first, r"^#+\s+", ""))).otherwise(body).alias("element"))


def with_paths(elements: DataFrame, key: str) -> DataFrame:
    """elements with header_path, the live headings at each one, as /a/b/; above the first heading it is //.

    A heading is live until one of its level or above comes, so one column per level holds the last heading of that level.
    """
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    levels = range(1, 7)
    last = elements.select("*", *[F.last(F.when(F.col("level") == j, F.struct("pos", "element")), ignorenulls=True).over(w).alias(f"_h{j}") for j in levels], F.last("level", ignorenulls=True).over(w).alias("_l"))
    names = []
    for j in levels:
        above = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"_h{i}.pos"), F.lit(-1)) for i in levels if i < j])
        names.append(F.when((F.col("_l") >= j) & (F.col(f"_h{j}.pos") > above), F.col(f"_h{j}.element")))
    path = F.concat(F.lit("/"), F.concat_ws("/", *names), F.lit("/"))
    return last.withColumn("header_path", path).drop("_l", *[f"_h{j}" for j in levels])


def heading_paths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, level, heading, header_path: the live headings above and including each one, as /a/b/."""
    titles = markdown_elements(docs, key, text).where("kind = 'title'")
    return with_paths(titles, key).select(key, "pos", "level", F.col("element").alias("heading"), "header_path")


def heading_chains(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, heading, chain: of each heading line all earlier headings of a smaller level, in order."""
    lines = document_lines(docs, key, text).withColumn("s", strip(F.col("line"))).where(F.col("s").rlike(r"^#{1,6}\s+\S"))
    h = lines.select(key, F.col("pos").alias("line_no"), F.length(F.regexp_extract("s", "^(#+)", 1)).alias("level"), strip(F.regexp_replace("s", r"^#+\s+", "")).alias("heading"))
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    before = h.withColumn("seen", F.collect_list(F.struct("level", "heading")).over(w))
    return before.select(key, "line_no", "heading", F.transform(F.filter("seen", lambda x: x["level"] < F.col("level")), lambda x: x["heading"]).alias("chain"))


def markdown_chunks(docs: DataFrame, limit_tokens: int = 512, max_chars: int = 3500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_index, header_path, has_code, has_table, chunk: elements of one section packed up to a number of tokens.

    Every chunk begins with its section's headings. Code and tables are chunks of their own; chunks of more than
    max_chars characters are cut into windows. Text above the first heading has the path //.
    """
    w = W.partitionBy(key).orderBy("pos")
    placed = with_paths(markdown_elements(docs, key, text), key).withColumn("section", F.sum((F.col("kind") == "title").cast("int")).over(w)).withColumnRenamed("header_path", "path")
    s = placed.where("kind <> 'title'").groupBy(key, "section", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "element"))).alias("e"), F.max((F.col("kind") == "code").cast("int")).alias("code"), F.max((F.col("kind") == "table").cast("int")).alias("tab"))
    alone = F.transform(F.filter("e", lambda x: x["kind"] != "text"), lambda x: F.struct(x["pos"].alias("pos"), x["element"].alias("t")))
    texts = pack(F.transform(F.filter("e", lambda x: x["kind"] == "text"), lambda x: x["element"]), limit_tokens, "\n", lambda x: F.floor(F.length(x) / 4), 1)
    prose = F.transform(texts, lambda x: F.struct(F.lit(-1).alias("pos"), x.alias("t")))
    rows = s.select(key, "section", "path", "code", "tab", F.posexplode(F.concat(prose, alone)).alias("n", "c"))
    sized = rows.select(key, "section", "path", "code", "tab", "n", F.posexplode(F.when(F.length("c.t") > max_chars, char_chunks(F.col("c.t"), max_chars, 50)).otherwise(F.array("c.t"))).alias("m", "body"))
    order = W.partitionBy(key).orderBy("section", "n", "m")
    return sized.select(key, (F.row_number().over(order) - 1).alias("chunk_index"), F.col("path").alias("header_path"), (F.col("code") == 1).alias("has_code"), (F.col("tab") == 1).alias("has_table"), F.concat(F.when(F.col("path") == "//", F.lit("")).otherwise(F.concat(F.col("path"), F.lit("\n"))), F.col("body")).alias("chunk"))


def semantic_chunks(docs: DataFrame, dim: int = 16, share: float = 0.95, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_index, chunk: sentences, cut where two neighbours' hashed word vectors are farther apart than at 95 % of a text's joints.

    Vectors are built-in expressions: counts of words by hash. Sentences without words are at distance 1 from all.
    """
    s = docs.select(key, F.posexplode(sentences(F.col(text))).alias("pos", "s"))
    words = F.regexp_extract_all(F.lower("s"), F.lit("[a-z0-9]+|[\\u4e00-\\u9fff]"), F.lit(0))
    dims = F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(dim)).cast("int"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(dims, lambda x: x == i)).cast("double"))
    w = W.partitionBy(key).orderBy("pos")

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    rows = s.withColumn("v", vector).withColumn("before", F.lag("v").over(w))
    norm = F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("before"), F.col("before")))
    rows = rows.withColumn("far", F.when(F.col("before").isNotNull(), F.when(norm > 0, 1 - dot(F.col("v"), F.col("before")) / norm).otherwise(1.0)))
    rows = rows.withColumn("limit", F.percentile("far", F.lit(share)).over(W.partitionBy(key)))
    cut = F.sum(F.coalesce((F.col("far") > F.col("limit")).cast("int"), F.lit(0))).over(w)
    parts = rows.withColumn("chunk_index", cut.cast("int")).groupBy(key, "chunk_index").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("l"))
    return parts.select(key, "chunk_index", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("chunk"))
