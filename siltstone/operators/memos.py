"""Stores of memos: merging, display, import and lists by page.

A store has the columns page_id, memo_id, text, created_at. Of two stores the
secondary wins where both have a memo. Nulls: memos without page or id are no
memos; a memo without a time counts as the oldest. Repeated memos of one store
count once, the last by time. Empty stores merge to the other one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("page_id", "memo_id")


def parse(stores: DataFrame, column: str = "json") -> DataFrame:
    """Memos out of the JSON of version 1 stores: ``{"version": 1, "memos": {page: [{id, text, createdAt}]}}``; anything else has none."""
    schema = "struct<version:int,memos:map<string,array<struct<id:string,text:string,createdAt:string>>>>"
    parsed = stores.select(F.from_json(column, schema).alias("s")).where("s.version = 1 and s.memos is not null")
    rows = parsed.select(F.explode("s.memos").alias("page_id", "l")).select("page_id", F.explode("l").alias("m"))
    return rows.select("page_id", F.col("m.id").alias("memo_id"), "m.text", F.try_to_timestamp("m.createdAt").alias("created_at"))


def merge(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """All memos of both stores; position is that in their page, by time."""
    both = primary.withColumn("_rank", F.lit(0)).unionByName(secondary.withColumn("_rank", F.lit(1))).where("page_id is not null and memo_id is not null")
    held = both.groupBy(*KEYS).agg(F.max_by(F.struct("text", "created_at"), F.struct("_rank", "created_at", "text")).alias("m")).select(*KEYS, "m.*")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("created_at").asc_nulls_first(), "memo_id"))
    return held.withColumn("position", place)


def displayed(shared: DataFrame, personal: DataFrame) -> DataFrame:
    """Shared memos that no personal one hides, and the personal ones; ``personal`` says which."""
    left = shared.join(personal.select(*KEYS).distinct(), list(KEYS), "left_anti").withColumn("personal", F.lit(False))
    return left.unionByName(personal.withColumn("personal", F.lit(True)))


def imported(own: DataFrame, other: DataFrame) -> DataFrame:
    """The memos of ``other`` whose ids ``own`` doesn't have."""
    return other.join(own.select("memo_id").distinct(), "memo_id", "left_anti")
