"""Mixing sources to target weights (problem 8).

Budgets go down a tree: all, domain, source, language. A domain's weight is the
sum of the target shares of its sources; a source has its target share; a
language of a source the power ``LANGUAGE_EXPONENT`` of its amount, so that
small languages weigh more than they hold. No leaf takes more than its tokens
times its source's cap of repeats. What a language can't take goes to the other
languages of the source, what a source can't take to the other sources of its
domain, and only then to other domains.

Each leaf takes whole epochs. The rest of a source's budget is a prefix of one
more epoch: every epoch of a leaf has a seeded order of its own, the leaves of
a source advance in step, each by its share of the rest, and the prefix ends at
the document that comes nearest to the source's rest. So a source is at most
half a document off its budget, whatever its languages' documents weigh. The
tree's table has a row per source and language; documents are ordered within
hash ranges, then within slices of the prefix only.

Nulls: null texts have no size and aren't selected; a source that is null or
has no target isn't either; an unknown language is the leaf 'und'. Texts
without tokens are never selected. Rows of one id, source, language and size
give one row with all their copies. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small_rows
from . import labelled, sizes

#: Hash ranges of a leaf's seeded order, and slices of a source's prefix.
RANGES, SLICES = 1024, 512
#: A prefix runs on in a leaf up to so many times its share of the rest, where other leaves fall short.
FAR = 8
#: What the kinds of sources belong to; a source that isn't named here is a domain of its own.
DOMAINS = {"readme": "reference", "api_page": "reference", "guide": "reference", "changelog": "project", "memo": "project", "issue": "project", "adr": "project"}
#: Languages of a source share its budget by this power of their amounts.
LANGUAGE_EXPONENT = 0.7


def fill(total: float, weights: dict, room: dict) -> dict:
    """Share ``total`` by ``weights``, nobody over its ``room``; what one can't take goes to the others by weight."""
    got = dict.fromkeys(weights, 0.0)
    free = {k for k, w in weights.items() if w > 0 and room[k] > 0}
    left = total
    while free and left > 1e-9:
        whole = sum(weights[k] for k in free)
        full = {k for k in free if got[k] + left * weights[k] / whole >= room[k]}
        if not full:
            for k in free:
                got[k] += left * weights[k] / whole
            break
        for k in full:
            left -= room[k] - got[k]
            got[k] = room[k]
        free -= full
    return got


def budgets(leaves: list[tuple[str, str, int]], targets: dict[str, tuple[float, int]], total: float, domains: dict[str, str], exponent: float = LANGUAGE_EXPONENT) -> dict[tuple[str, str], float]:
    """Budget of every leaf (source, language, tokens); ``targets`` are share and cap of repeats by source."""
    room = {(s, c): float(n * targets[s][1]) for s, c, n in leaves}
    by_source = {s: sum(r for (x, _), r in room.items() if x == s) for s in targets}
    members: dict[str, list[str]] = {}
    for s in targets:
        members.setdefault(domains.get(s, s), []).append(s)
    domain = fill(total, {d: sum(targets[s][0] for s in own) for d, own in members.items()}, {d: sum(by_source[s] for s in own) for d, own in members.items()})
    out: dict[tuple[str, str], float] = {}
    for d, sources in members.items():
        source = fill(domain[d], {s: targets[s][0] for s in sources}, {s: by_source[s] for s in sources})
        for s in sources:
            own = {(x, c): float(n) ** exponent for x, c, n in leaves if x == s}
            out |= fill(source[s], own, {k: room[k] for k in own})
    return out


def plan_of(leaves: list[tuple[str, str, int]], targets: dict[str, tuple[float, int]], total: float, domains: dict[str, str], exponent: float) -> list[tuple[str, str, int, float, float]]:
    """(source, lang, whole epochs, rest of the leaf, rest of the source)."""
    amount = {(s, c): n for s, c, n in leaves}
    rows = []
    for (s, c), b in budgets(leaves, targets, total, domains, exponent).items():
        epochs = min(int((b + 1e-6) // amount[s, c]), targets[s][1])
        rows.append((s, c, epochs, max(0.0, b - epochs * amount[s, c]) if epochs < targets[s][1] else 0.0))
    rest: dict[str, float] = {}
    for s, _, _, r in rows:
        rest[s] = rest.get(s, 0.0) + r
    return [(s, c, e, r, rest[s]) for s, c, e, r in rows]


def mix(
    documents: DataFrame, mix_targets: DataFrame, lang_codes: DataFrame, total: int | None = None, seed: int = 1, tokenizer: str = sizes.TOKENIZER,
    domains: dict[str, str] = DOMAINS, exponent: float = LANGUAGE_EXPONENT,
) -> DataFrame:
    """(doc_id, source, lang, tokens, copies) of the selected documents.

    ``total`` is the size of the mixture in tokens, by default that of all
    documents with a target, so that small sources repeat and large ones shrink.
    """
    spark = documents.sparkSession
    wanted = mix_targets.where("source is not null and target_share > 0 and max_repeats > 0")
    targets = {r["source"].strip().lower(): (float(r["target_share"]), int(r["max_repeats"])) for r in small_rows(wanted)}
    source = F.lower(F.trim("source"))
    code = F.coalesce(labelled.code_of(F.col("lang"), labelled.names_of(lang_codes)), F.lit("und"))
    docs = documents.select("doc_id", source.alias("source"), code.alias("lang"), "text").where(F.col("source").isin(*targets))
    sized = cut(sizes.with_tokens(docs, "doc_id", "text", {"source": "string", "lang": "string"}, tokenizer).where("tokens > 0"))
    # A row per source and language.
    leaves = [tuple(r) for r in small_rows(sized.groupBy("source", "lang").agg(F.sum("tokens")))]
    if total is None:
        total = sum(n for _, _, n in leaves)
    plan = spark.createDataFrame(plan_of(leaves, targets, total, domains, exponent), "source string, lang string, epochs int, rest double, source_rest double")
    held = sized.join(F.broadcast(plan), ["source", "lang"])
    epoch = held.where("rest > 0").withColumn("order", F.xxhash64(F.lit(seed), "epochs", "doc_id")).withColumn("range", F.shiftright("order", 54) + RANGES // 2)
    at = ["source", "lang"]
    placed = _running(epoch, at, "range", [F.col("order"), F.col("doc_id")])
    # Leaves of a source advance in step: a document's place is the share of the leaf's rest that it ends at.
    placed = placed.withColumn("place", F.col("upto") / F.col("rest")).where(F.col("place") <= FAR).withColumn("slice", F.floor(F.col("place") * SLICES)).drop("upto")
    taken = _running(placed, ["source"], "slice", [F.col("place"), F.col("lang"), F.col("doc_id")])
    # The prefix ends where it is nearest to the rest of the source.
    nearest = F.col("upto") - F.col("tokens") / 2 <= F.col("source_rest")
    last = taken.where(nearest).select("doc_id", "source", "lang", "tokens", F.lit(1).alias("copies"))
    whole = held.where("epochs > 0").select("doc_id", "source", "lang", "tokens", F.col("epochs").alias("copies"))
    both = whole.unionByName(last).groupBy("doc_id", "source", "lang", "tokens")
    return both.agg(F.sum("copies").cast("int").alias("copies"))


def _running(rows: DataFrame, at: list[str], part: str, order: list) -> DataFrame:
    """``rows`` with ``upto``, the tokens of a group up to each row in the order of ``part`` and ``order``; no group meets in one task."""
    before = Window.partitionBy(*at).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*at, part).agg(F.sum("tokens").alias("n")).select(*at, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.sum("tokens").over(Window.partitionBy(*at, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(F.broadcast(offsets), [*at, part]).withColumn("upto", F.col("offset") + F.col("inside")).drop("inside", "offset")


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, actual_share); sources that gave nothing have 0."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    rows = mix_targets.select(F.lower(F.trim("source")).alias("source"), "target_share").join(got, "source", "left").fillna(0, ["documents", "tokens"])
    whole = F.sum("tokens").over(Window.partitionBy())  # a row per source
    return rows.withColumn("actual_share", F.col("tokens") / whole)
