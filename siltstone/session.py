"""Session helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    The cluster names it in ``spark.checkpoint.dir``. Only where neither that
    setting nor a checkpoint folder exists (local tests) is one made here.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="siltstone-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The plan runs once and is written to the shared folder, so that several
    consumers read it instead of computing it again, and a lost executor loses
    nothing.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_rows(df: DataFrame, most: int = 10_000) -> list[Row]:
    """All rows of a table that is small by its nature; a table of more than ``most`` rows is an error, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of at most {most} rows was expected")
    return rows


def small_side(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast where Catalyst's estimate of its size allows it; else left to a shuffled join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions than there are: small compressed files of texts on which much work is done a row.

    A table of more partitions than cores is left as it is, without a shuffle.
    So is a plan that shuffles: to ask it for its partitions would run its
    shuffles, and their files would stay beside those of the run itself.
    """
    if re.search("(?<!Broadcast)Exchange", df._jdf.queryExecution().executedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
