"""Streams: incremental ingestion of nodes, windows over events, session state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import latest
from ..session import scratch


def ingest(arrivals: DataFrame, store: str, checkpoint: str):
    """A query that puts arriving nodes into a store: documents that arrive replace their former nodes.

    Every micro-batch is written as it is, as a part of its own that names its number: its cost does not depend on the
    store, and a batch that is run again writes the same part. What a part replaces is found when the store is read.
    """
    return arrivals.writeStream.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{store}/part={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_parts(spark: SparkSession, store: str) -> list[str]:
    """Folders of the store's parts that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in (fs.listStatus(path) if fs.exists(path) else []) if f.getPath().getName().startswith("part=")]
    return sorted(str(p) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, store: str, key: str = "node_id", document: str = "ref_doc_id") -> DataFrame:
    """The store as of its last complete part: a row counts if no later part brings its document or its key; of one part the last row of a key."""
    found = complete_parts(spark, store)
    if not found:
        raise ValueError(f"{store} holds no complete part")
    rows = spark.read.option("basePath", store).parquet(*found).withColumn("part", F.col("part").cast("long"))
    for name, last in ((document, "_d"), (key, "_k")):
        newest = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(last)).agg(F.max("part").alias(f"{last}_part"))
        rows = rows.join(newest, F.col(name) == F.col(last), "left").drop(last)
    alive = rows.where("(_d_part is null or part = _d_part) and part = _k_part").drop("part", "_d_part", "_k_part")
    return latest(alive, key)


def compact(spark: SparkSession, store: str, into: str) -> None:
    """The store as of now, written as the first part of a new one; streams that go on write their parts beside it with greater numbers."""
    current(spark, store).write.mode("overwrite").parquet(f"{into}/part=-1")


def hourly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """window start, event_type, n, total over one-hour windows; events later than `late` are left out of a running stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def run_to_end(result: DataFrame, what: str) -> DataFrame:
    """All updates that a stream over the files that are there gives, with the number of their micro-batch, as a table in the shared folder.

    In update mode the watermark drops state that no event can change any more; the last update of a key is its result.
    """
    spark = result.sparkSession
    out, marks = scratch(spark, what), scratch(spark, "marks")
    query = result.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/part={i}")).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    found = complete_parts(spark, out)
    schema = result.schema.add("part", "long")
    return spark.read.schema(schema).option("basePath", out).parquet(*found) if found else spark.createDataFrame([], schema)


def last_updates(updates: DataFrame, *keys: str) -> DataFrame:
    values = [c for c in updates.columns if c not in (*keys, "part")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "part").alias("_v")).select(*keys, "_v.*")


SESSION = "user_id long, sessions int, events int, last double"
GAP = 1800


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals joined wherever the gap between them is no longer than GAP, in order of time."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    begins = np.append(True, starts[1:] - ends[:-1] > GAP)[: len(starts)]
    return starts[begins], ends[np.append(begins[1:], True)[: len(starts)]]


def count_sessions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Numbers of sessions and events of a user so far; a gap of over 30 minutes begins a session.

    The state holds the intervals of the sessions that may still grow, so events may come in any order, in any batches; one
    that ended more than a gap before the watermark is only counted. Events without a time count as events only.
    """
    events, closed, last, starts, ends = state.get if state.exists else (0, 0, None, [], [])
    starts, ends = np.array(starts, float), np.array(ends, float)
    for pdf in batches:
        t = pdf["t"].dropna().to_numpy(float)
        events += len(pdf)
        starts, ends = merged(np.append(starts, t), np.append(ends, t))
    if len(ends):
        last = max(float(ends[-1]), last if last is not None else float(ends[-1]))
    passed = state.getCurrentWatermarkMs() / 1000
    over = ends + GAP < passed
    closed, starts, ends = closed + int(over.sum()), starts[~over], ends[~over]
    state.update((int(events), closed, last, starts.tolist(), ends.tolist()))
    if len(ends):
        state.setTimeoutTimestamp(int((max(ends[0] + GAP, passed) + 1) * 1000))
    yield pd.DataFrame({"user_id": [key[0]], "sessions": [closed + len(starts)], "events": [int(events)], "last": [last]})


def sessions(events: DataFrame, late: str = "1 day") -> DataFrame:
    """user_id, sessions, events, last: state per user kept by the stream.

    Events later than `late` are left out of a running stream, and so are events of 1970 and before, where Spark's watermark
    begins. Events without a time are counted, and belong to no session.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    timed = timed.withColumn("t", F.unix_micros("at").cast("double") / 1e6).select("user_id", "at", "t")
    return timed.groupBy("user_id").applyInPandasWithState(count_sessions, SESSION, "events int, closed int, last double, starts array<double>, ends array<double>", "update", GroupStateTimeout.EventTimeTimeout)
