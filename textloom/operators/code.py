"""Code in texts: fenced blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import markdown_elements


def code_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, language (null if none is named), lines, code of every fenced block; a block that is never closed counts."""
    blocks = markdown_elements(docs, key, text).where("kind = 'code'")
    name = F.regexp_extract("element", r"\A\s*```(\w*)", 1)
    body = F.regexp_replace(F.regexp_replace("element", r"\A[^\n]*(\n|\z)", ""), r"\n?[ \t]*```[^\n]*\z", "")
    return blocks.select(key, "pos", F.when(name != "", F.lower(name)).alias("language"), F.when(body == "", 0).otherwise(F.size(F.split(body, "\n"))).alias("lines"), body.alias("code"))
