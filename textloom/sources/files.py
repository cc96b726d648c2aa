"""Sources and sinks of texts, evaluation sets and chunks."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File types that can be loaded.
SUPPORTED = (".pdf", ".txt", ".md", ".docx", ".html", ".htm", ".json", ".csv", ".xlsx", ".pptx", ".py", ".java", ".cpp", ".c", ".h", ".hpp", ".go", ".js", ".ts", ".jsx", ".tsx")


#: Of those, the ones that are text.
TEXTS = tuple(e for e in SUPPORTED if e not in (".pdf", ".docx", ".xlsx", ".pptx"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of some paths that are there, in their order."""
    out = []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            out.append(p)
    return out


def _texts(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("source_file"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("bytes"))


def load_texts(spark: SparkSession, path: str, recursive: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """source_file, text, bytes of all supported text files below a folder, without those whose name, or whose path below the
    folder, fits one of some shell patterns (*, ? and [...]).

    A folder without files gives an empty table, and files of no bytes, which Spark passes over, give no row; bytes that are no UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    kept = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*TEXTS))
    below = F.expr("substring(path, locate(_root, path) + length(_root) + 1)")
    kept = kept.withColumn("_root", F.lit("/" + path.rstrip("/").rpartition("://")[2].strip("/")))
    for pattern in exclude:
        shape = fnmatch.translate(pattern)
        kept = kept.where(~F.substring_index("path", "/", -1).rlike(shape) & ~below.rlike(shape))
    return _texts(kept)


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """source_file, text, bytes of one file; a file that is not there or is no text is an error, not an empty table."""
    if not existing(spark, [path]):
        raise FileNotFoundError(path)
    if not path.lower().endswith(TEXTS):
        raise ValueError(f"no text file: {path}")
    return _texts(spark.read.format("binaryFile").load(path))


def load_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same of several files; those that are not there or are no texts are passed over."""
    found = existing(spark, [p for p in paths if p.lower().endswith(TEXTS)])
    return _texts(spark.read.format("binaryFile").load(found)) if found else spark.createDataFrame([], "source_file string, text string, bytes long")


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, kind, hash of the images below a folder; their content is read for the hash only."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("kind", kind).where(F.col("kind").isin("png", "jpg", "jpeg", "gif", "webp"))
    return files.select("path", F.col("length").alias("bytes"), "kind", F.sha2("content", 256).alias("hash"))


def eval_set_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """query, expected_ids, reference_answer of a CSV whose ids are joined by commas; blank ids are dropped."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema("query string, expected_ids string, reference_answer string").csv(path)
    ids = F.filter(F.transform(F.split(F.coalesce("expected_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("query", ids.alias("expected_ids"), "reference_answer")


def eval_set_from_json(spark: SparkSession, path: str) -> DataFrame:
    """query, expected_ids, reference_answer of a JSON file {"items": [...]} or a list of items."""
    item = "struct<query:string,expected_ids:array<string>,reference_answer:string>"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    wrapped = F.from_json("v", f"struct<items:array<{item}>>")["items"]
    plain = F.from_json("v", f"array<{item}>")
    return text.select(F.inline(F.when(F.startswith("v", F.lit("[")), plain).otherwise(wrapped)))


def write_chunks_jsonl(chunks: DataFrame, path: str) -> None:
    """One line {id, text, metadata} per chunk."""
    rest = [c for c in chunks.columns if c not in ("id", "text")]
    chunks.select("id", "text", F.struct(*rest).alias("metadata")).write.mode("overwrite").json(path)


def write_chunks_text(chunks: DataFrame, path: str) -> None:
    """One folder per source with the chunks' texts, each with its number above it."""
    line = F.concat(F.lit("# chunk "), F.lpad(F.col("chunk_index").cast("string"), 4, "0"), F.lit("\n"), F.col("text"), F.lit("\n"))
    chunks.select("source", line.alias("value")).write.mode("overwrite").partitionBy("source").text(path)


def write_store(nodes: DataFrame, path: str, by: str = "collection") -> None:
    """The node table, a folder per collection, so that a collection's readers see no other."""
    nodes.write.mode("overwrite").partitionBy(by).parquet(path)
