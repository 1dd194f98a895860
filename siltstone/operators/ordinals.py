"""Dense ordinals for keys, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups are numbered in so many hash slices, so that a group with a third of all rows is spread.
SLICES = 256


def with_ordinal(df: DataFrame, group: list[str], stage: list[str], key: list[str], name: str = "ordinal", slices: int = SLICES) -> DataFrame:
    """Number the rows of each ``group`` from 0, ordered by ``stage``, then by a hash slice and ``key``.

    Rows of a later stage only append, so that ordinals given once stay. ``df``
    is read twice (counts of the slices, then the rows): pass one whose lineage
    is cut. Counts per slice are summed up; rows are numbered within a slice
    only. ``group`` and ``stage`` must not be null.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*key), F.lit(slices)).cast("int"))
    at = [*group, *stage, "_slice"]
    before = Window.partitionBy(*group).orderBy(*stage, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*at).agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(*key)) - 1
    return sliced.withColumn("_inside", inside).join(offsets, at).withColumn(name, F.col("_offset") + F.col("_inside")).drop("_slice", "_inside", "_offset")
