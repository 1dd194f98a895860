"""Filling containers of fixed capacity with documents (problem 7).

Only sizes matter, and there are at most as many sizes as the capacity has
tokens. Spark counts the documents of each size; the plan is made on that
table, whose rows the capacity bounds (``MOST_SIZES``, checked), not on
documents. Martello and Toth's dominance first: for every size, in passes until
none changes anything, a set of one, two or three documents with it is fixed if
every other set with it could be exchanged for that one: nothing else fits; an
exact pair; one companion that outweighs any two that fit, or two that outweigh
any two, where no three fit. It is fixed for as many containers as there are
such sets. What the reduction can't fix is put by best fit, whole groups of
equal containers at a time. The plan gives each rank within a size its
container; Spark numbers the documents of a size and joins them to the plan.

A document larger than the capacity is split into full pieces and a rest; no
other is. Nulls: null texts have no size and no row. Texts without tokens take
no room: they have a row with container_no null. Repeated rows are packed each.
A capacity that is null or below 1 is left out. An empty table gives no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import with_ordinal
from ..session import cut, small_rows
from . import sizes

PLAN = "size bigint, from_rank bigint, to_rank bigint, first_container bigint, per_container bigint"


#: Most sizes that a plan is made for; a larger capacity is an error.
MOST_SIZES = 1 << 20
#: Rows up to which a plan is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 1 << 20


def _dominant(size: int, order: list[int], left: dict[int, int], capacity: int) -> list[int] | None:
    """The set with ``size`` that dominates all others with it, or None if none of up to three documents is known to."""

    def fitting(room: int, besides: list[int]) -> int | None:
        """The largest size up to ``room`` that is left when ``besides`` are taken."""
        i = bisect.bisect_right(order, room)
        while i:
            i -= 1
            if left[order[i]] > besides.count(order[i]):
                return order[i]
        return None

    room = capacity - size
    mate = fitting(room, [size])
    if mate is None:
        return [size]
    if mate == room:
        return [size, mate]
    # The three smallest others.
    small: list[int] = []
    for x in order[:4]:
        small += [x] * min(3, left[x] - (x == size))
    if len(small) < 2 or small[0] + small[1] > room:
        return [size, mate]
    if len(small) >= 3 and sum(small[:3]) <= room:
        return None
    # At most two fit beside it: the largest sum of two, and the largest second.
    best, lo, hi = 0, 0, bisect.bisect_right(order, room - small[0]) - 1
    while lo <= hi:
        a, b = order[lo], order[hi]
        if a + b > room:
            hi -= 1
            continue
        if a != b or left[a] - (a == size) >= 2:
            best = max(best, a + b)
        lo += 1
    if mate >= best:
        return [size, mate]
    second = fitting(room - mate, [size, mate])
    half = fitting(room // 2, [size])
    if second is not None and half is not None and second >= half:
        return [size, mate, second]
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, from rank, to rank, first container, per container): where the documents of each size go.

    Rank r of a row goes to container ``first + (r - from) // per``.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    order = sorted(left)
    out: list[tuple[int, int, int, int, int]] = []
    made = 0

    def take(size: int, n: int, first: int, per: int = 1) -> None:
        out.append((size, used[size], used[size] + n, first, per))
        used[size] += n
        left[size] -= n
        if not left[size]:
            del left[size]
            order.pop(bisect.bisect_left(order, size))

    # Reduction: passes over all sizes until none fixes a set.
    changed = True
    while changed and order:
        changed = False
        for size in reversed(order[:]):
            while left.get(size) and (found := _dominant(size, order, left, capacity)) is not None:
                used_of = {x: found.count(x) for x in found}
                n = min(left[x] // k for x, k in used_of.items())
                for x in found:
                    take(x, n, made)
                made += n
                changed = True
    # Best fit, groups of equal containers at a time: room -> groups of (first container, containers).
    rooms: dict[int, list[tuple[int, int]]] = {}
    keys: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in rooms:
                bisect.insort(keys, room)
                rooms[room] = []
            rooms[room].append((first, n))

    while order:
        size = order[-1]
        while left.get(size):
            at = bisect.bisect_left(keys, size)
            if at < len(keys):
                room = keys[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], keys[at]
                m = min(n, left[size])
                put(room, first + m, n - m)
                take(size, m, first)
                put(room - size, first, m)
            else:
                per = max(1, capacity // size)
                n, rest = divmod(left[size], per)
                if n:
                    take(size, n * per, made, per)
                    put(capacity - per * size, made, n)
                    made += n
                if rest:
                    take(size, rest, made, rest)
                    put(capacity - rest * size, made, 1)
                    made += 1
    return out


def pack(sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, tokens, container_no) of documents (doc_id, tokens) in containers of ``capacity``."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(capacity)))
    cutup = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), (pieces - 1).cast("bigint"))).alias("piece_no"))
    cutup = cutup.select("doc_id", "piece_no", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece_no") * capacity).alias("size"))
    held = cutup.where("size > 0")
    counts = {r["size"]: r["count"] for r in small_rows(held.groupBy("size").count(), min(capacity, MOST_SIZES))}
    rows = plan(counts, capacity)
    planned = sized.sparkSession.createDataFrame(rows, PLAN)
    planned = F.broadcast(planned) if len(rows) <= MOST_BROADCAST else planned
    ranked = with_ordinal(held, ["size"], [], ["doc_id", "piece_no"], "rank")
    there = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    placed = ranked.join(planned.withColumnRenamed("size", "p_size"), (F.col("size") == F.col("p_size")) & there)
    number = F.col("first_container") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("per_container"))
    full = placed.select("doc_id", "piece_no", F.col("size").alias("tokens"), number.cast("bigint").alias("container_no"))
    return full.unionByName(cutup.where("size <= 0").select("doc_id", "piece_no", F.col("size").alias("tokens"), F.lit(None).cast("bigint").alias("container_no")))


def pack_documents(documents: DataFrame, containers: DataFrame, tokenizer: str = sizes.TOKENIZER) -> DataFrame:
    """(container_kind, capacity, doc_id, piece_no, tokens, container_no) for every row of ``containers``, a small fixed table."""
    sized = cut(sizes.with_tokens(documents, "doc_id", "text", tokenizer=tokenizer))
    out = None
    for r in small_rows(containers.where("capacity_tokens > 0")):
        one = pack(sized, r["capacity_tokens"]).select(F.lit(r["container_kind"]).alias("container_kind"), F.lit(r["capacity_tokens"]).cast("bigint").alias("capacity"), "*")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else documents.sparkSession.createDataFrame([], "container_kind string, capacity bigint, doc_id bigint, piece_no bigint, tokens bigint, container_no bigint")


def report(packed: DataFrame) -> DataFrame:
    """(container_kind, containers, least, fill): containers used, the least possible by the total, and the mean fill."""
    per = packed.where("container_no is not null").groupBy("container_kind", "capacity").agg(F.countDistinct("container_no").alias("containers"), F.sum("tokens").alias("tokens"))
    return per.select("container_kind", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
