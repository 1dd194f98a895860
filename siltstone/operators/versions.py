"""Comparison of two versions of an analysis: collections of endpoints, entities, services and types.

A collection is compared by a full outer join on its key; what is nested in an
item (parameters, columns, relations, fields) is compared within the joined
row, so that it costs no further shuffle. Versions are the snapshots that a
project delivered; each is compared with the one before.

Nulls: a missing flag differs from a set one, null equals null. Of items with
one key in a version, or nested items with one name, the last one holds. Rows
without project or snapshot belong to no version. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT = ("project", "snapshot_no")


def endpoint_id() -> Column:
    """``METHOD:path``, ``operation:field`` or the name; a missing part reads ``undefined``."""
    part = lambda c: F.coalesce(c, F.lit("undefined"))
    two = lambda a, b: F.concat(part(a), F.lit(":"), part(b))
    return F.when(F.col("protocol") == "rest", two("httpMethod", "path")).when(F.col("protocol") == "graphql", two("operationType", "fieldName")).otherwise(part("name"))


def items(rows: DataFrame, key: Column, columns: Sequence[str], order: Sequence[str] = ("received_at", "row_id"), at: Sequence[str] = AT) -> DataFrame:
    """(at..., id, item): the last row of every key in every version."""
    kept = rows.where(" and ".join(f"{c} is not null" for c in at)).select(*at, key.alias("id"), F.struct(*columns).alias("item"), F.struct(*order).alias("order"))
    return kept.groupBy(*at, "id").agg(F.max_by("item", "order").alias("item"))


def versions(rows: DataFrame, at: Sequence[str] = AT) -> DataFrame:
    """(project, snapshot_no, next, first): the delivered versions of each project; ``next`` is null at the last."""
    project, number = at
    delivered = rows.where(f"{project} is not null and {number} is not null").select(*at).distinct()
    by = Window.partitionBy(project)
    return delivered.withColumns({"next": F.lead(number).over(by.orderBy(number)), "first": F.min(number).over(by)})


def paired(held: DataFrame, delivered: DataFrame, at: Sequence[str] = AT) -> DataFrame:
    """(at..., id, old, new): every item of a version next to that of the version before; the first version has no pairs."""
    project, number = at
    known = held.join(delivered, list(at))
    new = known.where(F.col(number) > F.col("first")).select(*at, "id", F.col("item").alias("new"))
    old = known.where("next is not null").select(project, F.col("next").alias(number), "id", F.col("item").alias("old"))
    return old.join(new, [*at, "id"], "full_outer")


def status(old: Column, new: Column, changed: Column) -> Column:
    return F.when(old.isNull(), "added").when(new.isNull(), "removed").when(changed, "modified").otherwise("unchanged")


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def nested(old: Column, new: Column, name: str, fields: Sequence[str]) -> Column:
    """Changes between two lists of structs by ``name``: structs of name, status and each field before and after; unchanged ones are left out."""
    was, now = (F.coalesce(x, F.array()) for x in (old, new))
    names = F.array_distinct(F.concat(F.transform(now, lambda x: x[name]), F.transform(was, lambda x: x[name])))
    of = lambda xs, n: F.try_element_at(F.filter(xs, lambda x: x[name].eqNullSafe(n)), F.lit(-1))
    found = F.transform(names, lambda n: F.struct(n.alias("name"), of(was, n).alias("was"), of(now, n).alias("now")))

    def change(x: Column) -> Column:
        changed = F.lit(False)
        for f in fields:
            changed = changed | differs(x["was"][f], x["now"][f])
        sides = [c for f in fields for c in (x["was"][f].alias(f"prev_{f}"), x["now"][f].alias(f"curr_{f}"))]
        return F.struct(x["name"].alias("name"), status(x["was"], x["now"], changed).alias("status"), *sides)

    return F.filter(F.transform(found, change), lambda x: x["status"] != "unchanged")


def set_changes(old: Column, new: Column) -> tuple[Column, Column, Column]:
    """(added, removed, kept) of two sets of texts, each sorted."""
    was, now = (F.coalesce(x, F.array().cast("array<string>")) for x in (old, new))
    return F.array_sort(F.array_except(now, was)), F.array_sort(F.array_except(was, now)), F.array_sort(F.array_intersect(now, was))


#: What is compared of the items of each collection: fields, nested list, its name and fields.
ENDPOINT, PARAMETER = ("returnType", "handler", "auth", "deprecated"), ("type", "required", "location")
ENTITY, COLUMN, RELATION = ("tableName",), ("type", "nullable"), ("type",)
TYPE, FIELD = ("kind",), ("type", "required")


def compare_endpoints(endpoints: DataFrame) -> DataFrame:
    """(project, snapshot_no, id, status, old, new, params) of all endpoints of consecutive versions, unchanged ones too."""
    held = items(endpoints, endpoint_id(), (*ENDPOINT, "name", "httpMethod", "operationType", "path", "fieldName", "protocol", "parameters"))
    pairs = paired(held, versions(endpoints)).withColumn("params", nested(F.col("old.parameters"), F.col("new.parameters"), "name", PARAMETER))
    return _with_status(pairs, ENDPOINT, ["params"])


def _with_status(pairs: DataFrame, fields: Sequence[str], nests: Sequence[str]) -> DataFrame:
    changed = F.lit(False)
    for f in fields:
        changed = changed | differs(F.col(f"old.{f}"), F.col(f"new.{f}"))
    for n in nests:
        changed = changed | (F.size(n) > 0)
    return pairs.withColumn("status", status(F.col("old"), F.col("new"), changed))


def compare_entities(entities: DataFrame, delivered: DataFrame) -> DataFrame:
    """The same of entities (project, snapshot_no, name, tableName, columns, relations) with ``columnChanges`` and ``relationChanges``."""
    held = entities.select(*AT, F.col("name").alias("id"), F.struct("tableName", "columns", "relations").alias("item"))
    pairs = paired(held, delivered).withColumns({
        "columnChanges": nested(F.col("old.columns"), F.col("new.columns"), "name", COLUMN),
        "relationChanges": nested(F.col("old.relations"), F.col("new.relations"), "target", RELATION),
    })
    return _with_status(pairs, ENTITY, ["columnChanges", "relationChanges"])


def compare_types(types: DataFrame, delivered: DataFrame) -> DataFrame:
    """The same of types (project, snapshot_no, name, kind, fields) with ``fieldChanges``."""
    held = types.select(*AT, F.col("name").alias("id"), F.struct("kind", "fields").alias("item"))
    pairs = paired(held, delivered).withColumn("fieldChanges", nested(F.col("old.fields"), F.col("new.fields"), "name", FIELD))
    return _with_status(pairs, TYPE, ["fieldChanges"])


def compare_services(services: DataFrame, delivered: DataFrame) -> DataFrame:
    """The same of services (project, snapshot_no, name, methods, dependencies) with the added and removed methods and dependencies."""
    held = services.select(*AT, F.col("name").alias("id"), F.struct("methods", "dependencies").alias("item"))
    pairs = paired(held, delivered)
    sets = {}
    for f in ("methods", "dependencies"):
        added, removed, _ = set_changes(F.col(f"old.{f}"), F.col(f"new.{f}"))
        sets |= {f"{f}Added": added, f"{f}Removed": removed}
    return _with_status(pairs.withColumns(sets), (), list(sets))


def summary(compared: dict[str, DataFrame]) -> DataFrame:
    """(project, snapshot_no, category, added, removed, modified, unchanged) of the compared collections."""
    out = None
    for category, df in compared.items():
        counts = df.groupBy(*AT).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified", "unchanged")])
        one = counts.select(*AT, F.lit(category).alias("category"), "added", "removed", "modified", "unchanged")
        out = one if out is None else out.unionByName(one)
    return out


def breaking(endpoints: DataFrame, entities: DataFrame, types: DataFrame) -> DataFrame:
    """(project, snapshot_no, severity, category, name, reason) of the changes that break callers.

    Critical: an endpoint or entity is gone, a parameter is new and required or
    became required. Warnings: another return type, a parameter, column or type
    is gone, another nullability.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit("undefined"))
    rules = []

    def rule(df: DataFrame, severity: str, category: str, name: Column, reason: Column) -> None:
        rules.append(df.select(*AT, F.lit(severity).alias("severity"), F.lit(category).alias("category"), name.alias("name"), reason.alias("reason")))

    gone = lambda df: df.where("status = 'removed'")
    method = F.coalesce("old.httpMethod", "old.operationType", F.upper("old.protocol"))
    place = F.coalesce("old.path", "old.fieldName", F.lit(""))
    rule(gone(endpoints), "critical", "endpoint", F.col("old.name"), F.concat(F.lit("Endpoint removed: "), text(method), F.lit(" "), place))
    changed = endpoints.where("status = 'modified'")
    types_differ = changed.where(differs(F.col("old.returnType"), F.col("new.returnType")))
    rule(types_differ, "warning", "endpoint", F.col("new.name"), F.concat(F.lit("Return type changed: "), text(F.col("old.returnType")), F.lit(" → "), text(F.col("new.returnType"))))
    params = changed.select(*AT, F.col("new.name").alias("owner"), F.explode("params").alias("p")).select(*AT, "owner", "p.*")
    required = F.coalesce("curr_required", F.lit(False))
    rule(params.where((F.col("status") == "added") & required), "critical", "endpoint", F.col("owner"), F.concat(F.lit("New required parameter: "), text(F.col("name")), F.lit(" ("), text(F.col("curr_type")), F.lit(")")))
    rule(params.where("status = 'removed'"), "warning", "endpoint", F.col("owner"), F.concat(F.lit("Parameter removed: "), text(F.col("name"))))
    became = (F.col("status") == "modified") & ~F.coalesce("prev_required", F.lit(False)) & required
    rule(params.where(became), "critical", "endpoint", F.col("owner"), F.concat(F.lit("Parameter became required: "), text(F.col("name"))))
    rule(gone(entities), "critical", "entity", F.col("id"), F.lit("Entity/table removed"))
    columns = entities.where("status = 'modified'").select(*AT, "id", F.explode("columnChanges").alias("c")).select(*AT, "id", "c.*")
    rule(columns.where("status = 'removed'"), "warning", "entity", F.col("id"), F.concat(F.lit("Column removed: "), text(F.col("name"))))
    other = (F.col("status") == "modified") & differs(F.col("prev_nullable"), F.col("curr_nullable"))
    rule(columns.where(other), "warning", "entity", F.col("id"), F.concat(F.lit("Column nullability changed: "), text(F.col("name"))))
    rule(gone(types), "warning", "type", F.col("id"), F.lit("Type removed"))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def change_log(endpoints: DataFrame, entities: DataFrame, services: DataFrame) -> DataFrame:
    """(project, snapshot_no, type, category, name, detail): the log of added, removed and modified endpoints, entities and services.

    An endpoint is modified by another handler, return type or set of
    parameters (name, type, required); an entity by another table, columns
    (name, type, nullable) or number of relations; a service by other methods or
    dependencies.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit("undefined"))
    arrow = lambda label, a, b: F.when(differs(a, b), F.concat(F.lit(f"{label}: "), text(a), F.lit(" → "), text(b)))
    count = lambda xs: F.size(F.coalesce(xs, F.array()))
    counts = lambda label, f: arrow(label, count(F.col(f"old.{f}")), count(F.col(f"new.{f}")))
    detail = lambda fallback, *parts: F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit(fallback))
    prints = lambda xs, *fs: F.array_sort(F.transform(F.coalesce(xs, F.array()), lambda x: F.concat_ws(":", *[text(x[f]) for f in fs])))
    other = lambda f, *fs: differs(prints(F.col(f"old.{f}"), *fs), prints(F.col(f"new.{f}"), *fs))

    def log(df: DataFrame, category: str, name: Column, plain: Column, changed: Column, modified: Column) -> DataFrame:
        state = status(F.col("old"), F.col("new"), changed)
        rows = df.withColumn("type", state).where("type <> 'unchanged'")
        return rows.select(*AT, "type", F.lit(category).alias("category"), name.alias("name"), F.when(F.col("type") == "modified", modified).otherwise(plain).alias("detail"))

    def place(side: str) -> Column:
        two = lambda a, b: F.concat(text(F.col(f"{side}.{a}")), F.lit(" "), text(F.col(f"{side}.{b}")))
        protocol = F.col(f"{side}.protocol")
        return F.when(protocol == "rest", two("httpMethod", "path")).when(protocol == "graphql", two("operationType", "fieldName")).otherwise(F.col(f"{side}.name"))

    was, now = (lambda f: F.col(f"old.{f}")), (lambda f: F.col(f"new.{f}"))
    none = F.lit(None).cast("string")
    of_endpoints = log(
        endpoints, "endpoint", F.coalesce(now("name"), was("name")), F.when(now("name").isNotNull() | now("protocol").isNotNull(), place("new")).otherwise(place("old")),
        differs(was("handler"), now("handler")) | differs(was("returnType"), now("returnType")) | other("parameters", "name", "type", "required"),
        detail("signature changed", arrow("return type", was("returnType"), now("returnType")), counts("parameters", "parameters")),
    )
    of_entities = log(
        entities, "entity", F.col("id"), none, differs(was("tableName"), now("tableName")) | other("columns", "name", "type", "nullable") | differs(count(was("relations")), count(now("relations"))),
        detail("schema changed", arrow("table", was("tableName"), now("tableName")), counts("columns", "columns"), counts("relations", "relations")),
    )
    sets = lambda f: differs(F.array_sort(F.coalesce(was(f), F.array())), F.array_sort(F.coalesce(now(f), F.array())))
    of_services = log(services, "service", F.col("id"), none, sets("methods") | sets("dependencies"), detail("implementation changed", counts("methods", "methods"), counts("dependencies", "dependencies")))
    return of_endpoints.unionByName(of_entities).unionByName(of_services)


#: Titles of a release note, in their order. Fixed values.
TITLES = (("added", "Added"), ("modified", "Changed"), ("removed", "Removed"))


def release_notes(changes: DataFrame) -> DataFrame:
    """(project, snapshot_no, note): a Markdown note per version out of a change log; entries stand by category, name and detail.

    The note of one version is one text, as large as its list of changes.
    """
    line = F.concat(
        F.lit("- **"), F.concat(F.upper(F.substring("category", 1, 1)), F.expr("substr(category, 2)")), F.lit("**: `"), F.coalesce("name", F.lit("undefined")), F.lit("`"),
        F.coalesce(F.concat(F.lit(" - "), F.nullif("detail", F.lit(""))), F.lit("")),
    )
    lists = changes.withColumn("line", line).groupBy(*AT).agg(*[F.array_sort(F.collect_list(F.when(F.col("type") == t, F.col("line")))).alias(t) for t, _ in TITLES])
    part = lambda t, title: F.when(F.size(t) > 0, F.concat(F.lit(f"### {title}\n\n"), F.array_join(t, "\n"), F.lit("\n\n")))
    return lists.select(*AT, F.concat(F.lit("## ["), F.col("snapshot_no").cast("string"), F.lit("]\n\n"), F.concat_ws("", *[part(t, title) for t, title in TITLES])).alias("note"))


#: Marks of states in reports. Fixed values.
ICONS = {"added": "+", "removed": "-", "modified": "~"}


def report(endpoints: DataFrame) -> DataFrame:
    """(project, snapshot_no, report): a Markdown report per version out of compared endpoints, by id; as large as its list of changes."""
    icon = lambda c: F.when(c == "added", ICONS["added"]).when(c == "removed", ICONS["removed"]).otherwise(ICONS["modified"])
    text = lambda c: F.coalesce(c, F.lit("undefined"))
    changed = F.col("status") == "modified"
    lines = F.transform(F.array_sort("params"), lambda p: F.concat(F.lit("  - "), icon(p["status"]), F.lit(" `"), text(p["name"]), F.lit("`: "), F.coalesce(p["prev_type"], F.lit("n/a")), F.lit(" → "), F.coalesce(p["curr_type"], F.lit("n/a"))))
    part = F.concat(
        F.lit("### "), icon(F.col("status")), F.lit(" "), F.coalesce("new.httpMethod", "old.httpMethod", F.lit("")), F.lit(" "), F.coalesce("new.path", "old.path", "new.name", "old.name", F.lit("")), F.lit("\n"),
        F.when(changed & differs(F.col("old.returnType"), F.col("new.returnType")), F.concat(F.lit("\n- Return type: `"), text(F.col("old.returnType")), F.lit("` → `"), text(F.col("new.returnType")), F.lit("`"))).otherwise(""),
        F.when(changed & differs(F.col("old.auth"), F.col("new.auth")), "\n- Auth requirement changed").otherwise(""), F.when(F.size("params") > 0, F.concat(F.lit("\n- Parameters:\n"), F.array_join(lines, "\n"))).otherwise(""),
    )
    rows = endpoints.where("status <> 'unchanged'").select(*AT, "id", "status", part.alias("part"))
    lists = rows.groupBy(*AT).agg(F.array_sort(F.collect_list(F.struct("id", "part"))).alias("l"), *[F.count_if(F.col("status") == s).cast("string").alias(s) for s in ICONS])
    head = F.concat(F.lit("# API Changes: "), F.col("snapshot_no").cast("string"), F.lit("\n\n| Added | Removed | Modified |\n|---|---|---|\n| "), F.concat_ws(" | ", "added", "removed", "modified"), F.lit(" |\n\n"))
    return lists.select(*AT, F.concat(head, F.array_join(F.transform("l", lambda x: x["part"]), "\n\n")).alias("report"))
