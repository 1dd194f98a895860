"""Queries that run as streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir
from ..streaming import watch
from ..tables import read
from .base import Book

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle


@BOOK.query(
    """with b as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hours then 0 else 1 end as b from events where ts is not null),
s as (select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) as events from (select *, sum(b) over (partition by user_id order by ts, event_id) as s from b) group by user_id, s)
select user_id, events, (epoch_us(start) // 1000)::bigint as start_ms, (epoch_us("end") // 1000)::bigint as end_ms from s where epoch_us("end") // 1000 <= (select epoch_us(max(ts)) // 1000 from events)"""
)
def watch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events per user that are over, by a stream over the table's file."""
    folder = f"{checkpoint_dir(spark)}/watch-{uuid.uuid4().hex}"
    events = watch.file_stream(spark, sf_dir, read(spark, sf_dir, "events"), "events.parquet")
    watch.run_available(watch.bursts(events.selectExpr("user_id", "cast(ts as timestamp) as ts"), "user_id", gap="6 hours"), f"{folder}/state", f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows").selectExpr("user_id", "events", "unix_millis(start) as start_ms", "unix_millis(end) as end_ms")
