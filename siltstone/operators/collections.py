"""The collections of an analysis that are worked out from its endpoints: services, entities and types of each delivered version.

``held`` are the endpoints that hold in each version (project, snapshot_no,
id, item), see :func:`siltstone.operators.versions.items`. Nulls: endpoints
without the name that a collection goes by give it nothing; null lists are
empty. Repeated members count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import versions

COLUMNS = ("name", "protocol", "httpMethod", "operationType", "path", "fieldName", "handler", "handlerClass", "returnType", "serviceRef", "auth", "deprecated", "parameters")


def held(endpoints: DataFrame) -> DataFrame:
    return versions.items(endpoints, versions.endpoint_id(), COLUMNS)


def services(held: DataFrame) -> DataFrame:
    """(project, snapshot_no, name, methods, dependencies): a service per handling class, with its endpoints and what they refer to."""
    rows = held.where("item.handlerClass is not null").groupBy(*versions.AT, F.col("item.handlerClass").alias("name"))
    return rows.agg(F.array_sort(F.collect_set("item.name")).alias("methods"), F.array_sort(F.collect_set("item.serviceRef")).alias("dependencies"))


def entities(held: DataFrame) -> DataFrame:
    """(project, snapshot_no, name, tableName, columns, relations): an entity per service that endpoints refer to.

    Its columns are the parameters of these endpoints, null where none requires
    them; its relations go to what they return.
    """
    name = F.regexp_replace("item.serviceRef", "Service$", "")
    rows = held.where("item.serviceRef is not null").select(*versions.AT, name.alias("name"), F.col("item.parameters").alias("ps"), F.col("item.returnType").alias("rt"))
    params = rows.select(*versions.AT, "name", F.explode("ps").alias("p")).where("p.name is not null")
    columns = params.groupBy(*versions.AT, "name", F.col("p.name").alias("column")).agg(F.min("p.type").alias("type"), (~F.max(F.coalesce("p.required", F.lit(False)))).alias("nullable"))
    columns = columns.groupBy(*versions.AT, "name").agg(F.array_sort(F.collect_list(F.struct(F.col("column").alias("name"), "type", "nullable"))).alias("columns"))
    target = F.regexp_replace("rt", r"(\[\])+$", "")
    many = F.when(F.max(F.col("rt").endswith("[]")), "OneToMany").otherwise("ManyToOne")
    relations = rows.where("rt is not null").groupBy(*versions.AT, "name", target.alias("target")).agg(many.alias("type"))
    relations = relations.groupBy(*versions.AT, "name").agg(F.array_sort(F.collect_list(F.struct("target", "type"))).alias("relations"))
    every = rows.select(*versions.AT, "name").distinct()
    joined = every.join(columns, [*versions.AT, "name"], "left").join(relations, [*versions.AT, "name"], "left")
    return joined.select(*versions.AT, "name", F.concat(F.lower("name"), F.lit("s")).alias("tableName"), "columns", "relations")


def types(held: DataFrame) -> DataFrame:
    """(project, snapshot_no, name, kind, fields): the input of each handler, with its parameters as fields; of a handler's endpoints the last by id counts."""
    rows = held.where("item.handler is not null and size(item.parameters) > 0").groupBy(*versions.AT, F.col("item.handler").alias("handler")).agg(F.max_by("item.parameters", "id").alias("ps"))
    fields = F.transform("ps", lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), p["required"].alias("required")))
    return rows.select(*versions.AT, F.concat("handler", F.lit("Input")).alias("name"), F.lit("input").alias("kind"), fields.alias("fields"))
