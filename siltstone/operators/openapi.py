"""Operations, entities and types out of OpenAPI documents in JSON, parsed by Spark.

References go to the schemas of the same document, one level deep. ``allOf``
merges properties, the later ones hold, and adds up what is required. Nulls:
files without content or that are no OpenAPI document give no rows. Repeated
files each give their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = "type:string,format:string,`$ref`:string,enum:array<string>"
PROPERTY = f"struct<{LEAF},items:struct<{LEAF}>>"
OBJECT = f"struct<{LEAF},items:struct<{LEAF}>,properties:map<string,{PROPERTY}>,required:array<string>,description:string,`x-entity`:boolean"
SCHEMA = OBJECT + ",allOf:array<" + OBJECT + ">>>"
CONTENT = f"content:map<string,struct<schema:{PROPERTY}>>"
OPERATION = f"struct<operationId:string,summary:string,description:string,tags:array<string>,deprecated:boolean,security:array<map<string,array<string>>>,parameters:array<struct<name:string,`in`:string,required:boolean,type:string,schema:{PROPERTY}>>,requestBody:struct<required:boolean,{CONTENT}>,responses:map<string,struct<schema:{PROPERTY},{CONTENT}>>>"
DOCUMENT = f"struct<openapi:string,swagger:string,basePath:string,paths:map<string,map<string,{OPERATION}>>,components:struct<schemas:map<string,{SCHEMA}>>,definitions:map<string,{SCHEMA}>>"
VERBS = ("get", "post", "put", "patch", "delete")


def documents(files: DataFrame) -> DataFrame:
    """(file_id, spec) of the files (file_id, content) that are OpenAPI documents of version 2 or 3."""
    spec = F.from_json("content", DOCUMENT)
    marked = files.where(F.col("content").rlike(r"\"(?:openapi|swagger)\"\s*:"))
    return marked.select("file_id", spec.alias("spec")).where("coalesce(spec.openapi, spec.swagger) is not null")


def _leaf(s: Column) -> Column:
    return F.coalesce(F.regexp_extract(s["$ref"], r"([^/]+)$", 1), F.when(F.size(s["enum"]) > 0, F.array_join(s["enum"], " | ")), F.when(s["format"].isin("date", "date-time"), "Date"), s["type"])


def type_text(s: Column) -> Column:
    """A schema as the name of a type: reference, list, enum, date or plain; ``any`` without one."""
    return F.coalesce(F.when(s["type"] == "array", F.concat(F.coalesce(_leaf(s["items"]), F.lit("any")), F.lit("[]"))), _leaf(s), F.lit("any"))


def operations(docs: DataFrame, include_deprecated: bool = True) -> DataFrame:
    """(file_id, method, path, name, parameters, returnType, tags, auth, deprecated) of documents; the body is the parameter ``body``."""
    rows = docs.select("file_id", "spec.basePath", F.explode("spec.paths").alias("path", "item")).select("file_id", "basePath", "path", F.explode("item").alias("verb", "op")).where(F.col("verb").isin(*VERBS))
    own = F.transform(F.coalesce("op.parameters", F.array()), lambda p: F.struct(p["name"].alias("name"), F.coalesce(F.when(p["schema"].isNotNull(), type_text(p["schema"])), p["type"], F.lit("any")).alias("type"), F.coalesce(p["required"], F.lit(False)).alias("required"), p["in"].alias("location")))
    first = lambda content: F.try_element_at(F.map_values(content), F.lit(1))["schema"]
    body = F.when(F.col("op.requestBody").isNotNull(), F.array(F.struct(F.lit("body").alias("name"), type_text(first(F.col("op.requestBody.content"))).alias("type"), F.coalesce("op.requestBody.required", F.lit(False)).alias("required"), F.lit("body").alias("location")))).otherwise(F.array())
    answer = F.coalesce(F.try_element_at("op.responses", F.lit("200")), F.try_element_at("op.responses", F.lit("201")))
    returned = F.coalesce(first(answer["content"]), answer["schema"])
    out = rows.select(
        "file_id", F.upper("verb").alias("method"), F.concat(F.coalesce("basePath", F.lit("")), "path").alias("path"), F.coalesce("op.operationId", F.concat("verb", F.lit(" "), "path")).alias("name"), F.concat(own, body).alias("parameters"),
        F.when(returned.isNotNull(), type_text(returned)).otherwise("void").alias("returnType"), F.col("op.tags").alias("tags"), (F.size(F.coalesce("op.security", F.array())) > 0).alias("auth"), F.coalesce("op.deprecated", F.lit(False)).alias("deprecated"),
    )
    return out if include_deprecated else out.where("not deprecated")


def schemas(docs: DataFrame) -> DataFrame:
    """(file_id, name, kind, fields, values): schemas as entity (has an id, or is marked), enum or object, with what ``allOf`` adds."""
    named = docs.select("file_id", F.coalesce("spec.components.schemas", "spec.definitions").alias("all")).where("all is not null").select("file_id", "all", F.explode("all").alias("name", "s"))
    target = lambda x: F.try_element_at(F.col("all"), F.regexp_extract(F.coalesce(x["$ref"], F.lit("")), r"([^/]+)$", 1))
    parts = F.coalesce(F.col("s.allOf"), F.array())
    entries = lambda m: F.coalesce(F.map_entries(m), F.array())
    pairs = F.concat(F.flatten(F.transform(parts, lambda x: F.concat(entries(target(x)["properties"]), entries(x["properties"])))), entries(F.col("s.properties")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    needed = F.array_distinct(F.concat(F.flatten(F.transform(parts, lambda x: F.concat(F.coalesce(target(x)["required"], F.array()), F.coalesce(x["required"], F.array())))), F.coalesce(F.col("s.required"), F.array())))
    rows = named.select("file_id", "name", "s", pairs.alias("pairs"), names.alias("names"), needed.alias("needed"))
    field = lambda n: F.struct(n.alias("name"), type_text(F.element_at(F.filter("pairs", lambda e: e["key"] == n), -1)["value"]).alias("type"), F.array_contains("needed", n).alias("required"))
    kind = F.when(F.size(F.coalesce("s.enum", F.array())) > 0, "enum").when(F.coalesce("s.x-entity", F.lit(False)) | F.arrays_overlap("names", F.array(F.lit("id"), F.lit("_id"))), "entity").otherwise("object")
    return rows.select("file_id", "name", kind.alias("kind"), F.transform("names", field).alias("fields"), F.col("s.enum").alias("values"))
