"""References to records that do not exist.

Keys are dictionary-encoded as integers, laid out in key ranges. References and parents become bitmaps per key range
and period; parents are added up over the periods, and reference AND-NOT parent leaves the bits of the keys with a broken
reference, which are decoded again and joined with the references themselves, where an exact comparison gives the reason.
References with the state of their records, and the dictionary, are staged: each is made once, however often it is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import staged

#: Keys meant for one range, below the 32 768 bits of one of Spark's bitmaps.
KEYS_PER_RANGE = 24_000
RANGE_BITS = 24
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def norm_key(key: Column) -> Column:
    """Lower-cased, without surrounding white space; null for null and blank keys."""
    out = F.regexp_replace(F.lower(key), f"^{WHITE}|{WHITE}$", "")
    return F.when(out != "", out)


def with_states(rows: DataFrame) -> DataFrame:
    """rows (key, ref_key, at, deleted), one per delivery and reference -> one per key and ref_key: at, the earliest delivery
    that makes the reference, first_at, the earliest of the record, and gone, whether it is deleted as of its latest one.

    A record without references keeps one row with a null ref_key. Repeated rows are reduced before they are shuffled; a record
    with very many references is joined with its state, so that it can be split.
    """
    each = rows.where("key is not null").groupBy("key", "ref_key").agg(F.min("at").alias("at"), F.max(F.struct("at", "deleted")).alias("last"))
    state = each.groupBy("key").agg(F.min("at").alias("first_at"), F.max("last").alias("last"))
    return each.drop("last").join(state, "key").select("key", "ref_key", "at", "first_at", F.col("last.deleted").alias("gone"))


def _month(at: Column) -> Column:
    return F.substring(at.cast("string"), 1, 7)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _surviving(ref: pd.Series, parent: pd.Series) -> pd.Series:
    """Positions of the bits that are set in ref and not in parent."""

    def decode(a: bytes, b: bytes | None) -> np.ndarray:
        bits = np.frombuffer(a, np.uint8)
        if b is not None:
            bits = bits & ~np.frombuffer(b, np.uint8)
        return np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.int32)

    return pd.Series([decode(a, b) for a, b in zip(ref, parent)])


def key_dictionary(keys: DataFrame, ranges: int) -> DataFrame:
    """keys (space, key, ...), unique -> with block and bit, the integer code of the key: its bitmap and its place there.

    The range comes from the key's hash; within it keys are numbered in order, so a range is the unit of work and no
    task sees more than one range's keys.
    """
    spread = F.pmod(F.xxhash64("key"), F.lit(ranges))
    place = F.row_number().over(W.partitionBy("space", "range").orderBy("key")) - 1
    code = F.shiftleft(F.col("range"), RANGE_BITS) + F.col("place")
    return (
        keys.withColumn("range", spread)
        .withColumn("place", place.cast("long"))
        .withColumn("block", F.shiftright(code, 15))
        .withColumn("bit", code.bitwiseAND(F.lit(32767)))
        .drop("range", "place")
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose parent is missing, deleted or late.

    refs: src_table, src_key, ref_key, at - one row per reference, at = its earliest delivery.
    parents: src_table (the table whose references point here), key, first_at, deleted - one row per record.
    Out: src_table, src_key, ref_key, reason, ref_month. A reference to itself, ties of times and repeated deliveries
    need no special case: equal times are on time. Empty inputs give an empty result; without parents every reference
    is missing.
    """
    refs = refs.withColumn("ref_month", _month(F.col("at")))
    used = refs.groupBy(F.col("src_table").alias("space"), F.col("ref_key").alias("key"), "ref_month").agg(F.min("at").alias("at"))
    known = parents.select(F.col("src_table").alias("space"), "key", "first_at", "deleted", F.lit(True).alias("there"), F.lit(None).cast("string").alias("ref_month"), F.lit(None).cast(refs.schema["at"].dataType).alias("at"))
    wanted = used.select("space", "key", F.lit(None).cast(known.schema["first_at"].dataType).alias("first_at"), F.lit(None).cast("boolean").alias("deleted"), F.lit(None).cast("boolean").alias("there"), "ref_month", "at")
    # One row per key, with the months that refer to it; those are as many as there are periods.
    merged = staged(
        known.unionByName(wanted)
        .groupBy("space", "key")
        .agg(F.max("first_at").alias("first_at"), F.max("deleted").alias("deleted"), F.max("there").alias("there"), F.collect_list(F.when(F.col("ref_month").isNotNull(), F.struct("ref_month", "at"))).alias("asked")),
        "keys",
    )
    codes = staged(key_dictionary(merged, max(1, -(-merged.count() // KEYS_PER_RANGE))), "codes")

    live = F.col("there") & ~F.col("deleted")
    coded = codes.select("space", "block", "bit", "first_at", live.alias("live"), F.inline("asked"))
    early = F.coalesce(F.col("live") & (_month(F.col("first_at")) == F.col("ref_month")) & (F.col("at") < F.col("first_at")), F.lit(False))
    bits = (
        coded.withColumn("early", early)
        .groupBy("space", "block", F.col("ref_month").alias("month"))
        .agg(F.expr("bitmap_construct_agg(bit)").alias("ref_bits"), F.expr("bitmap_construct_agg(bit) filter (where early)").alias("early_bits"))
    )
    here = codes.where(live).groupBy("space", "block", _month(F.col("first_at")).alias("month")).agg(F.expr("bitmap_construct_agg(bit)").alias("live_bits"))
    # Parents up to each month: a running OR over the months of a block.
    both = bits.withColumn("live_bits", F.lit(None).cast("binary")).unionByName(here.withColumn("ref_bits", F.lit(None).cast("binary")).withColumn("early_bits", F.lit(None).cast("binary")))
    until = W.partitionBy("space", "block").orderBy("month").rangeBetween(W.unboundedPreceding, W.currentRow)
    cleared = both.withColumn("live_bits", F.expr("bitmap_or_agg(live_bits)").over(until)).where("ref_bits is not null")
    left = cleared.select("space", "block", F.col("month").alias("ref_month"), F.explode(F.array_union(_surviving("ref_bits", "live_bits"), _surviving("early_bits", F.lit(None).cast("binary")))).alias("bit")).withColumn("bit", F.col("bit").cast("long"))
    broken = left.join(codes, ["space", "block", "bit"]).select(F.col("space").alias("src_table"), F.col("key").alias("ref_key"), "ref_month", "first_at", "deleted", "there")
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("first_at") > F.col("at"), "late")
    return (
        refs.join(broken, ["src_table", "ref_key", "ref_month"])
        .withColumn("reason", reason)
        .where("reason is not null")
        .select("src_table", "src_key", "ref_key", "reason", "ref_month")
    )


def node_doc_orphans(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Orphan references between a node table (node_id -> ref_doc_id) and a document table (ref_doc_id -> node_ids).

    Columns besides node_id, ref_doc_id, node_ids, loaded_at and deleted_at are ignored. Null and blank keys are no
    references and no records; a null or unreadable node_ids lists nothing; a row without loaded_at counts as loaded
    first of all, in month 0001-01. References of records whose latest row is deleted do not count.
    """
    nowhen = F.lit("0001-01-01 00:00:00").cast(nodes.schema["loaded_at"].dataType)

    def rows(df: DataFrame, key: str, *more: Column) -> DataFrame:
        return df.select(norm_key(F.col(key)).alias("key"), F.coalesce("loaded_at", nowhen).alias("at"), F.col("deleted_at").isNotNull().alias("deleted"), *more)

    n = rows(nodes, "node_id", norm_key(F.col("ref_doc_id")).alias("ref_key"))
    listed = rows(docs, "ref_doc_id", F.from_json("node_ids", T.ArrayType(T.StringType())).alias("ids"))
    d = listed.select("key", "at", "deleted", F.explode_outer("ids").alias("id")).select("key", "at", "deleted", norm_key(F.col("id")).alias("ref_key"))
    found = {"kb_nodes": staged(with_states(n), "references"), "kb_docs": staged(with_states(d), "references")}
    refs = parents = None
    for name, other in (("kb_nodes", "kb_docs"), ("kb_docs", "kb_nodes")):
        own = found[name].where("ref_key is not null and not gone").select(F.lit(name).alias("src_table"), F.col("key").alias("src_key"), "ref_key", "at")
        to = found[other].groupBy("key").agg(F.min("first_at").alias("first_at"), F.max("gone").alias("deleted")).withColumn("src_table", F.lit(name))
        refs, parents = (own, to) if refs is None else (refs.unionByName(own), parents.unionByName(to))
    return orphan_references(refs, parents)
