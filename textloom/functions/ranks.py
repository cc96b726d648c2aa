"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def numbered_within(rows: DataFrame, key: str, part: Column, order: list[str], name: str) -> DataFrame:
    """rows with their number, from 1, within a key in the given order.

    part must grow with the order: rows are numbered within (key, part) and the numbers of the parts before are added,
    so that even one key's rows are spread over many tasks. The window over parts sees one row per part.
    """
    split = rows.withColumn("_part", part)
    sizes = split.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), before.alias("_start"))
    own = F.row_number().over(W.partitionBy(key, "_part").orderBy(*order))
    joined = split.withColumn("_own", own).join(starts, F.col(key).eqNullSafe(F.col("_k")) & F.col("_part").eqNullSafe(F.col("_p")))
    return joined.withColumn(name, (F.col("_own") + F.col("_start")).cast("int")).drop("_part", "_own", "_k", "_p", "_start")
