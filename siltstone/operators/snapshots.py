"""What changed between full snapshots (problem 3).

Every key of a project has a persistent ordinal: keys are numbered in the order
of the snapshot that first held them, so that later snapshots only append. With
a stored table of ordinals (:func:`ordinals`) known keys keep theirs whatever is
delivered later, and new keys are numbered behind them. A snapshot is a bitmap over the ordinals, compressed in that only the words of 64
ordinals which hold a key exist. Next to each word stands a vector of the rows'
fingerprints, aligned with its set bits. AND-NOT of the words of neighbouring
snapshots gives additions and removals; the vectors are compared where both
have the bit. Only the changes then meet the texts of their keys again.

Nulls: rows without project or snapshot number belong to no snapshot; rows
whose key is null (a REST row without path, say) are no records, but show that
the snapshot was delivered. Null lists equal empty ones; other nulls equal only
nulls. Repeated rows and ties in ``received_at`` are settled by the largest
``row_id``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordinals import with_ordinal


def endpoint_key() -> Column:
    """``rest:METHOD:path``, ``graphql:operationType:fieldName`` or ``protocol:name``."""
    rest = F.concat(F.lit("rest:"), F.upper(F.trim("httpMethod")), F.lit(":"), F.regexp_replace(F.trim("path"), "/+$", ""))
    graphql = F.concat(F.lit("graphql:"), F.col("operationType"), F.lit(":"), F.col("fieldName"))
    return F.when(F.col("protocol") == "rest", rest).when(F.col("protocol") == "graphql", graphql).otherwise(F.concat("protocol", F.lit(":"), F.col("name")))


def endpoint_fingerprint() -> Column:
    """What makes an endpoint another one: handler, return type, set of parameters."""
    params = F.transform(F.coalesce("parameters", F.array()), lambda p: _hash(p["name"], p["type"], p["required"]))
    return _hash(F.col("handler"), F.col("returnType"), F.sort_array(F.array_distinct(params)))


def _hash(*values: Column) -> Column:
    """Hash of values in which a null differs from every value and from a null elsewhere."""
    return F.xxhash64(*values, F.array(*[v.isNull() for v in values]))


def _histories(rows: DataFrame) -> DataFrame:
    """(project, key, first, history): per key the marks of the snapshots that hold it; an entry per snapshot, which are few."""
    held = rows.where("key is not null").groupBy("project", "key", "snap").agg(F.max_by("mark", "at").alias("mark"))
    return held.groupBy("project", "key").agg(F.min("snap").alias("first"), F.collect_list(F.struct("snap", "mark")).alias("history"))


def _numbered(keys: DataFrame, known: DataFrame | None) -> DataFrame:
    """``keys`` with their ordinals: those of ``known`` (project, key, ordinal), the others behind them."""
    if known is None:
        return with_ordinal(keys, ["project"], ["first"], ["key"])
    met = cut(keys.join(known.select("project", "key", F.col("ordinal").alias("_known")), ["project", "key"], "left"))
    fresh = with_ordinal(met.where("_known is null").drop("_known"), ["project"], ["first"], ["key"], "_new")
    start = known.groupBy("project").agg((F.max("ordinal") + 1).alias("_start"))
    fresh = fresh.join(start, "project", "left").withColumn("ordinal", F.col("_new") + F.coalesce("_start", F.lit(0))).drop("_new", "_start")
    return met.where("_known is not null").withColumnRenamed("_known", "ordinal").unionByName(fresh)


def _plain(rows: DataFrame, project: str, snapshot: str, key: str, mark: str, order: tuple[str, ...]) -> DataFrame:
    return rows.select(F.col(project).alias("project"), F.col(snapshot).alias("snap"), F.col(key).alias("key"), F.col(mark).alias("mark"), F.struct(*order).alias("at")).where("project is not null and snap is not null")


def ordinals(rows: DataFrame, known: DataFrame | None = None, project: str = "project", snapshot: str = "snapshot_no", key: str = "key") -> DataFrame:
    """(project, key, ordinal) of all keys of ``rows`` and of ``known``: the table to store for the next delivery."""
    keys = rows.where(F.col(project).isNotNull() & F.col(snapshot).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(project).alias("project"), F.col(key).alias("key")).agg(F.min(snapshot).alias("first"))
    found = _numbered(cut(keys), known).select("project", "key", "ordinal")
    return found if known is None else found.unionByName(known.select("project", "key", "ordinal").join(found, ["project", "key"], "left_anti"))


def diff_snapshots(rows: DataFrame, project: str = "project", snapshot: str = "snapshot_no", key: str = "key", mark: str = "mark", order: tuple[str, ...] = ("received_at", "row_id"), known: DataFrame | None = None) -> DataFrame:
    """(project, snapshot_no, key, change) between each snapshot and the delivered one before it.

    ``mark`` is the fingerprint of a record. Of the rows of one key in one
    snapshot the last by ``order`` holds. ``known`` are stored ordinals.
    """
    rows = _plain(rows, project, snapshot, key, mark, order)
    delivered = rows.select("project", "snap").distinct().withColumn("next", F.lead("snap").over(Window.partitionBy("project").orderBy("snap")))
    numbered = _numbered(cut(_histories(rows)), known)
    bits = numbered.select("project", F.shiftright("ordinal", 6).alias("word"), F.col("ordinal").bitwiseAND(63).cast("int").alias("bit"), F.explode("history").alias("h"))
    words = bits.groupBy("project", "word", F.col("h.snap").alias("snap")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.map_from_entries(F.collect_list(F.struct("bit", F.col("h.mark").alias("m")))).alias("vec")
    )
    words = words.join(delivered, ["project", "snap"])
    old = words.where("next is not null").select("project", "word", F.col("next").alias("snap"), F.col("bits").alias("old_bits"), F.col("vec").alias("old_vec"))
    first = delivered.groupBy("project").agg(F.min("snap").alias("first"))
    both = words.drop("next").join(old, ["project", "word", "snap"], "full_outer").join(first, "project").where("snap > first")
    both = both.withColumn("bits", F.coalesce("bits", F.lit(0).cast("bigint"))).withColumn("old_bits", F.coalesce("old_bits", F.lit(0).cast("bigint")))
    member = "filter(sequence(0, 63), b -> getbit({0}, b) = 1)"
    found = both.select(
        "project", "snap", "word",
        F.explode(
            F.concat(
                F.expr("transform(" + member.format("bits & ~old_bits") + ", b -> struct(b as bit, 'added' as change))"),
                F.expr("transform(" + member.format("old_bits & ~bits") + ", b -> struct(b as bit, 'removed' as change))"),
                F.expr("transform(filter(" + member.format("bits & old_bits") + ", b -> vec[b] <> old_vec[b]), b -> struct(b as bit, 'modified' as change))"),
            )
        ).alias("c"),
    )
    changes = found.select("project", F.col("snap").alias("snapshot_no"), (F.shiftleft("word", 6) + F.col("c.bit")).alias("ordinal"), F.col("c.change").alias("change"))
    return changes.join(numbered.select("project", "ordinal", "key"), ["project", "ordinal"]).select("project", "snapshot_no", "key", "change")


def endpoint_changes(endpoints: DataFrame) -> DataFrame:
    """(project, snapshot_no, endpoint_key, change) of an endpoints table."""
    rows = endpoints.select("project", "snapshot_no", "received_at", "row_id", endpoint_key().alias("key"), endpoint_fingerprint().alias("mark"))
    return diff_snapshots(rows).withColumnRenamed("key", "endpoint_key")
