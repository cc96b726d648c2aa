"""Document transforms: running lines, headings, tables, images, titles, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import join_lines, map_lines, matches

# Shapes of table lines and of numbered headings, and bounds of a repeated line.
TABLE_RULE, TABLE_ROW = r"^[|\s\-:]+$", r"^\|.+\|$"
NUMBERED = r"^(#+)\s*(?:\*{2})?(\d+(?:\.\d+)*)(?:\*{2})?\s+"
LINE_MIN, LINE_MAX, REPEATS = 5, 100, 3
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+$", "")


def is_table_line(line: Column) -> Column:
    return line.rlike(TABLE_RULE) | line.rlike(TABLE_ROW)


def document_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, line; null texts have none, an empty text has one empty line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, n: stripped lines of 5 to 100 characters, outside tables, that stand at least 3 times in one document."""
    lines = document_lines(docs, key, text).select(key, strip(F.col("line")).alias("line"))
    fit = F.length("line").between(LINE_MIN, LINE_MAX) & ~is_table_line(F.col("line"))
    return lines.where(fit).groupBy(key, "line").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATS)


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text without lines that equal, begin or end with a repeated one; table lines stay.

    Runs of blank lines become one and the ends are stripped; a document without repeated lines stays as it is. The
    few repeated lines of a document travel to its text as one array, so texts are never cut into rows.
    """
    found = repeated_lines(docs, key, text).groupBy(key).agg(F.collect_list("line").alias("marks"))
    joined = docs.select(key, text).join(found, key, "left")
    kept = F.filter(
        F.split(text, "\n"),
        lambda x: is_table_line(strip(x)) | ~F.exists("marks", lambda m: F.startswith(strip(x), m) | F.endswith(strip(x), m)),
    )
    cleaned = strip(F.regexp_replace(join_lines(kept), r"\n{3,}", "\n\n"))
    return joined.select(key, F.when(F.col("marks").isNull(), F.col(text)).otherwise(cleaned).alias("text"))


def strip_heading_marks(text: Column) -> Column:
    """Heading marks go from lines whose heading has no number."""
    heading = r"^#+\s+(.+)$"
    return map_lines(text, lambda x: F.when(x.rlike(heading) & ~x.rlike(NUMBERED), strip(F.regexp_extract(x, heading, 1))).otherwise(x))


def fix_heading_levels(text: Column) -> Column:
    """Numbered headings get the level of their number's parts, 6 at most; bold marks go."""

    def fix(x: Column) -> Column:
        number = F.regexp_extract(x, NUMBERED, 2)
        level = F.least(F.size(F.split(number, r"\.")), F.lit(6))
        rest = strip(F.replace(F.regexp_replace(x, NUMBERED, ""), F.lit("**"), F.lit("")))
        return F.when(x.rlike(NUMBERED), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), number, F.lit(" "), rest)).otherwise(x)

    return map_lines(text, fix)


def images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (order in the text), alt_text, path, image_id (file name without its extension)."""
    alts, paths = matches(F.col(text), IMAGE, 1), matches(F.col(text), IMAGE, 2)
    rows = docs.select(key, F.posexplode(F.arrays_zip(alts.alias("a"), paths.alias("p"))).alias("n", "i"))
    name = F.substring_index("i.p", "/", -1)
    return rows.select(key, "n", F.col("i.a").alias("alt_text"), F.col("i.p").alias("path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("image_id"))


def table_islands(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start_line, end_line, rows: tables, a row line followed by a separator line and then row lines.

    Islands of neighbouring table lines are found by the difference of line number and running number, per document.
    """
    lines = document_lines(docs, key, text).withColumn("line", strip(F.col("line"))).where(is_table_line(F.col("line")))
    w = W.partitionBy(key).orderBy("pos")
    islands = lines.withColumn("island", F.col("pos") - F.row_number().over(w)).withColumn("rule", (F.col("line").rlike(TABLE_RULE) & F.contains("line", F.lit("-"))).cast("int"))
    return (
        islands.groupBy(key, "island")
        .agg(F.min("pos").alias("start_line"), F.max("pos").alias("end_line"), F.sum(1 - F.col("rule")).alias("rows"), F.min(F.when(F.col("rule") == 1, F.col("pos"))).alias("rule_line"))
        .where(F.col("rule_line") == F.col("start_line") + 1)
        .select(key, "start_line", "end_line", "rows")
    )


# A table's title line, and the lines at which the search for one ends.
TABLE_TITLE, TITLE_STOPS = r"^\*{0,2}表\s*\*{0,2}([0-9][-.0-9]*)\s*\*{0,2}\s*(.*)$", r"^(?:#|\*{0,2}表)"
#: Lines above a table that are searched for its title.
TITLE_REACH = 9


def table_titles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, table_no, start_line, title, link of every table; the title is empty where the nearest heading or title line above is none."""
    tables = table_islands(docs, key, text).withColumn("table_no", F.row_number().over(W.partitionBy(key).orderBy("start_line")))
    lines = document_lines(docs, key, text).select(F.col(key).alias("_k"), "pos", strip(F.col("line")).alias("line")).where(F.col("line").rlike(TITLE_STOPS))
    above = tables.join(lines, (F.col(key) == F.col("_k")) & F.col("pos").between(F.col("start_line") - TITLE_REACH, F.col("start_line") - 1))
    nearest = above.groupBy(key, "table_no").agg(F.max_by("line", "pos").alias("line")).where(F.col("line").rlike(TABLE_TITLE))
    named = tables.join(nearest, [key, "table_no"], "left").withColumn("title", F.coalesce(F.rtrim(F.regexp_replace("line", TABLE_TITLE, "表 $1 $2")), F.lit("")))
    name = F.substring(F.regexp_replace("title", r"[^\p{L}\p{N}_-]", "_"), 1, 50)
    link = F.concat(F.lit("["), "title", F.lit("](tables/table_"), F.col("table_no").cast("string"), F.lit("_"), name, F.lit(".md)"))
    return named.select(key, "table_no", "start_line", "title", link.alias("link"))


def title(text: Column) -> Column:
    """The heading if the text is one heading line, else the first of 5 lines with more than 10 characters that is none, cut to 50; may be null."""
    whole = F.regexp_extract(text, r"\A#\s+([^\n]+)\z", 1)
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 5), strip), lambda x: (F.length(x) > 10) & ~F.startswith(x, F.lit("#")))
    return F.when(whole != "", strip(whole)).otherwise(F.substring(F.get(lines, F.lit(0)), 1, 50))


def mostly_chinese(text: Column, characters: int = 500, share: float = 0.3) -> Column:
    """zh if more than 30 % of the first 500 characters are Chinese, else en; an empty text is en."""
    head = F.substring(text, 1, characters)
    return F.when(F.length(F.regexp_replace(head, "[^一-鿿]", "")) > share * F.length(head), "zh").otherwise("en")
