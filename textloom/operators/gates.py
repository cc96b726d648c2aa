"""Quality gate of extracted documents, and texts put together from results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of

# Words that make a step one that can be carried out.
ACTIONS = ("执行", "运行", "修改", "配置", "重启", "安装", "更新", "设置", "调整")
# What the gate reports, in the order of its checks.
TOO_SHORT, NO_SOLUTION, NOT_COMPLETE = "文档内容过短，信息不足", "缺少明确的解决方案", "三要素内容不完整"
LOW_SCORE, CONTRADICTS = "完整性不足", "存在矛盾"
# Least characters of a document, least completeness, completeness that is taken where none is known.
LEAST_CHARS, LEAST_SCORE, USUAL_SCORE = 100, 0.5, 0.7


def record_text(title: Column, problem: Column, cause: Column, steps: Column) -> Column:
    """The parts of an extracted document as one text; null and missing parts are left out."""
    return F.concat_ws("\n\n", title, problem, cause, F.array_join(steps, "\n"))


def gate(records: DataFrame) -> DataFrame:
    """records (record_id, text, problem, steps, commands, step_commands, completeness, consistent) -> with has_solution, issues, reason, passed.

    steps, commands and step_commands are lists, null ones count as empty. Unknown completeness and consistency pass.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    acts = some("steps") & any_of(F.lower(F.array_join("steps", " ")), list(ACTIONS))
    has_solution = acts | some("commands") | F.coalesce(F.exists("step_commands", lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(False))
    basic = (F.coalesce("problem", F.lit("")) != "") & (some("steps") | some("commands"))
    score = F.coalesce("completeness", F.lit(USUAL_SCORE))
    issues = F.array(
        F.when(F.length("text") < LEAST_CHARS, TOO_SHORT),
        F.when(~F.col("has_solution"), NO_SOLUTION),
        F.when(~basic, NOT_COMPLETE),
        F.when(score < LEAST_SCORE, LOW_SCORE),
        F.when(~F.coalesce("consistent", F.lit(True)), CONTRADICTS),
    )
    checked = records.withColumn("has_solution", has_solution).withColumn("issues", F.filter(issues, lambda x: x.isNotNull()))
    return checked.withColumn("reason", F.get("issues", F.lit(0))).withColumn("passed", F.size("issues") == 0)


def hints(codes: Column, phrases: Column, environment: Column, services: Column, keywords: Column) -> Column:
    """Lines of what the rules found, for an extractor's prompt. environment: array of (key, value)."""
    pairs = F.transform(environment, lambda e: F.concat_ws(": ", e["key"], e["value"]))
    lines = [F.when(F.size(c) > 0, F.concat(F.lit(name), F.array_join(c, ", "))) for name, c in zip(HINTS, (codes, phrases, pairs, services, keywords))]
    return F.when(F.coalesce(*lines).isNotNull(), F.concat_ws("\n", *lines)).otherwise(NO_HINTS)


# How hint lines begin, and the text without any.
HINTS, NO_HINTS = ("错误码: ", "日志特征: ", "环境信息: ", "相关服务组件: ", "问题关键词: "), "未识别到特定信息"
# Beginnings of lines that a model's list of variants may hold beside them.
LEAD_INS = ("原问题", "变体", "Query", "要求", "输出")
SPACES = "^[ \t\r\n\f]+|[ \t\r\n\f]+$"


def tool_variants(answer: Column, query: Column, n: int = 3) -> Column:
    """Query variants in a model's answer as the search tool reads them; the query itself if there are none."""
    bare = lambda x: F.regexp_replace(x, SPACES, "")
    lines = F.filter(F.transform(F.split(answer, "\n"), bare), lambda x: (x != "") & ~x.rlike("^(?:" + "|".join(LEAD_INS) + ")"))
    cut = F.transform(lines, lambda x: F.when((F.length(x) > 2) & x.rlike(r"^[0-9][.: ]"), bare(F.substring(x, 3, 1_000_000))).otherwise(x))
    found = F.filter(cut, lambda x: x != "")
    return F.slice(F.when(F.size(found) > 0, found).otherwise(F.array(query)), 1, n)


def numbered_blocks(rows: DataFrame, key: str, order: str, text: Column, name: str) -> DataFrame:
    """key, name: the texts of a key one after the other in their order; the rows of a key are a short result list."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("_t")))), lambda x: x["_t"]), "").alias(name))


def source_block(rank: Column, score: Column, text: Column, cut: int = 300) -> Column:
    shown = F.concat(F.substring(text, 1, cut), F.when(F.length(text) > cut, "...").otherwise(""))
    return F.concat(F.lit("\n### Source ["), rank.cast("string"), F.lit("] (Score: "), F.format_string("%.3f", score), F.lit(")\n```\n"), shown, F.lit("\n```"))


def image_block(number: Column, path: Column) -> Column:
    n = number.cast("string")
    return F.concat(F.lit("\n### Image "), n, F.lit("\n![Image "), n, F.lit("]("), path, F.lit(")\n"))


def image_contexts(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """key, position, path, alt, context of every image: half of `reach` characters before and after it, without blanks at the ends."""
    pattern = r"!\[([^\]]*)\]\(([^)]+)\)"
    parts, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cut = docs.where(F.contains(text, F.lit("!["))).select(key, F.col(text).alias("_x"), parts.alias("_p"), found.alias("_f"))
    sizes = lambda c, n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    rows = cut.select(key, "_x", "_p", "_f", F.posexplode("_f").alias("position", "_m"))
    start = sizes("_p", F.col("position") + 1) + sizes("_f", F.col("position"))
    rows = rows.select(key, "position", "_x", "_m", start.alias("_s"))
    low = F.greatest(F.col("_s") - reach, F.lit(0))
    before = F.regexp_replace(F.substring(F.col("_x"), low + 1, F.col("_s") - low), SPACES, "")
    after = F.regexp_replace(F.substring(F.col("_x"), F.col("_s") + F.length("_m") + 1, F.lit(reach)), SPACES, "")
    context = F.concat_ws(" ", F.right(before, F.lit(reach // 2)), F.left(after, F.lit(reach // 2)))
    return rows.select(key, "position", F.regexp_extract("_m", pattern, 2).alias("path"), F.regexp_extract("_m", pattern, 1).alias("alt"), F.regexp_replace(context, SPACES, "").alias("context"))
