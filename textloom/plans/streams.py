"""Queries that run a stream over the given tables to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read, scratch
from ..streaming import ingest as S
from .stores import _LATEST, _SHOWN

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    """The files of a table as a stream; a table is a file or a folder of files."""
    return spark.readStream.schema(read(spark, d, table).schema).parquet(f"{d}/{table}*.parquet")


@query
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    done = S.last_updates(S.run_to_end(S.hourly(stream(spark, d, "events")), "windows"), "hour", "event_type")
    return done.select(F.unix_seconds("hour").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


SQL["stream_windows"] = "select epoch(date_trunc('hour', ts))::bigint as hour, event_type, count(*) n, round(sum(value), 4) total from events group by all"


@query
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return S.last_updates(S.run_to_end(S.sessions(stream(spark, d, "events")), "sessions"), "user_id").select("user_id", "sessions", "events")


SQL["stream_sessions"] = "select user_id, (sum((epoch_us(ts) - coalesce(p, -1e18) > 1800e6)::int))::int sessions, count(*)::int events from (select *, epoch_us(lag(ts) over (partition by user_id order by ts)) p from events) group by 1"


@query
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The node table put into a store by a stream: the last row of each node, with its document and length."""
    store = scratch(spark, "store")
    S.ingest(stream(spark, d, "kb_nodes"), store, scratch(spark, "marks")).awaitTermination()
    return S.current(spark, store).select("node_id", "ref_doc_id", F.length("text").alias("chars"), F.col("deleted_at").isNotNull().alias("deleted"))


SQL["stream_ingest"] = f"select {_SHOWN} from {_LATEST.format('true')}"
