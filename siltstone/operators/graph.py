"""Edges between services, entities, types and modules of a project, their figures, and diagrams of them.

Collections have a ``project`` column; nothing is joined across projects.
Nulls: rows without project or name have no node; null lists are empty. Edges
between the same two nodes count once. A diagram shows at most ``limit`` nodes of
a project, the first by name: that is its feature, and bounds its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import _inside_pairs


def service_edges(services: DataFrame) -> DataFrame:
    """(project, source, target): what each service (project, name, dependencies) depends on."""
    return services.select("project", F.col("name").alias("source"), F.explode("dependencies").alias("target")).distinct()


def entity_services(services: DataFrame, entities: DataFrame, strip: bool = False) -> DataFrame:
    """(project, entity, service): a dependency meets the first entity of its project by name that holds it or that it holds.

    With ``strip`` the ends ``Repository`` and ``Service`` of a dependency don't
    count. The names meet by their parts, not pair by pair.
    """
    dep = F.regexp_replace("target", "(Repository|Service)$", "") if strip else F.col("target")
    deps = service_edges(services).select("project", F.col("source").alias("service"), dep.alias("dep")).where("dep <> ''")
    names = entities.select("project", F.col("name").alias("entity")).where("entity <> ''").distinct()
    words, parts = deps.select(F.col("dep").alias("word")).distinct(), names.select(F.col("entity").alias("part")).distinct()
    holds = _inside_pairs(words, parts).select(F.col("word").alias("dep"), F.col("part").alias("entity"))
    held = _inside_pairs(parts.withColumnRenamed("part", "word"), words.withColumnRenamed("word", "part")).select(F.col("part").alias("dep"), F.col("word").alias("entity"))
    met = deps.join(holds.unionByName(held).distinct(), "dep").join(names, ["project", "entity"])
    return met.groupBy("project", "service", "dep").agg(F.min("entity").alias("entity")).select("project", "entity", "service").distinct()


def flows(entities: DataFrame, endpoints: DataFrame, limit: int = 10) -> DataFrame:
    """(project, entity, service, endpoint, rank): paths from an entity over the service of its name to the endpoints that refer to it, the first ``limit`` of a project."""
    steps = entities.select("project", F.col("name").alias("entity"), F.concat("name", F.lit("Service")).alias("service"))
    refs = endpoints.where("serviceRef is not null").select("project", F.col("serviceRef").alias("service"), F.col("id").alias("endpoint"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy("entity", "service", "endpoint"))
    return steps.join(refs, ["project", "service"]).distinct().withColumn("rank", rank).where(F.col("rank") <= limit).select("project", "entity", "service", "endpoint", "rank")


def degrees(edges: DataFrame) -> DataFrame:
    """(project, node, uses, used_by): distinct neighbours of each node of the edges."""
    both = edges.select("project", F.col("source").alias("node"), F.lit(1).alias("uses"), F.lit(0).alias("used_by")).unionByName(edges.select("project", F.col("target").alias("node"), F.lit(0).alias("uses"), F.lit(1).alias("used_by")))
    return both.groupBy("project", "node").agg(F.sum("uses").alias("uses"), F.sum("used_by").alias("used_by"))


def modules(nodes: DataFrame, entities: DataFrame, services: DataFrame, types: DataFrame) -> DataFrame:
    """(project, node, module, shape): the folder of a node's file, of a type before a service before an entity; ``other`` without one.

    The shape says what a node is: entity, service, enum or plain, in that order.
    """
    side = lambda df, name: df.where(f"{name}_path is not null").groupBy("project", "node").agg(F.min(f"{name}_path").alias(f"{name}_path"))
    found = nodes.select("project", "node").distinct()
    for name, df in (("entity", entities), ("service", services), ("type", types)):
        found = found.join(side(df.select("project", F.col("name").alias("node"), F.col("path").alias(f"{name}_path")), name), ["project", "node"], "left")
    enums = types.where("kind = 'enum'").select("project", F.col("name").alias("node"), F.lit(True).alias("enum")).distinct()
    module = F.coalesce(*[T.module_of(F.col(f"{n}_path")) for n in ("type", "service", "entity")], F.lit("other"))
    shape = F.when(F.col("entity_path").isNotNull(), "entity").when(F.col("service_path").isNotNull(), "service").when(F.col("enum"), "enum").otherwise("plain")
    return found.join(enums, ["project", "node"], "left").select("project", "node", module.alias("module"), shape.alias("shape"))


def first_nodes(df: DataFrame, name: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each project by ``name``."""
    return df.where(F.col(name).isNotNull() & F.col("project").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("project").orderBy(name))).where(F.col("_n") <= limit).drop("_n")


def diagram(head: str, *parts: DataFrame) -> DataFrame:
    """(project, code, edges): the lines (project, a, b, line, edge) of ``parts``, part by part in the order of a and b, under ``head``."""
    out = None
    for i, part in enumerate(parts):
        one = part.select("project", F.lit(i).alias("part"), F.col("a").cast("string"), F.col("b").cast("string"), "line", F.col("edge").cast("bigint").alias("edge"))
        out = one if out is None else out.unionByName(one)
    lists = out.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))).alias("l"), F.sum("edge").alias("edges"))
    return lists.select("project", F.concat(F.lit(head + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("code"), "edges")


def line(df: DataFrame, a: Column, b: Column, text: Column, edge: bool = False) -> DataFrame:
    return df.select("project", a.alias("a"), b.alias("b"), text.alias("line"), F.lit(int(edge)).alias("edge"))


#: Marks of relations, kinds and edges in diagrams. Fixed values.
CARDINALITY = {"OneToOne": "||--||", "OneToMany": "||--o{", "ManyToOne": "}o--||", "ManyToMany": "}o--o{"}
STEREOTYPE = {"interface": "~interface~", "enum": "~enumeration~", "dto": "~DTO~", "input": "~input~", "response": "~response~"}


def lookup(table: dict[str, str], c: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c), F.lit(other))


def er_diagram(entities: DataFrame, limit: int = 30) -> DataFrame:
    """Entities with their columns, and relations between shown entities."""
    shown = first_nodes(entities, "name", limit)
    name = T.sanitize_id(F.col("name"))
    columns = F.array_join(F.transform(F.coalesce("columns", F.array()), lambda c: F.concat(F.lit("        "), T.sanitize_type(F.coalesce(c["type"], F.lit(""))), F.lit(" "), T.sanitize_id(c["name"]), F.lit("\n"))), "")
    nodes = line(shown, F.col("name"), F.lit(""), F.concat(F.lit("    "), name, F.lit(" {\n"), columns, F.lit("    }")))
    relations = shown.select("project", "name", F.explode("relations").alias("r")).select("project", "name", F.col("r.target").alias("target"), F.col("r.type").alias("type"))
    relations = relations.join(shown.select("project", F.col("name").alias("target")), ["project", "target"], "left_semi")
    edges = line(relations, F.col("name"), F.col("target"), F.concat(F.lit("    "), name, F.lit(" "), lookup(CARDINALITY, F.col("type"), "||--||"), F.lit(" "), T.sanitize_id(F.col("target")), F.lit(' : "'), F.col("type"), F.lit('"')), True)
    return diagram("erDiagram", nodes, edges)


def service_diagram(services: DataFrame, limit: int = 30) -> DataFrame:
    """Services with the number of their methods, and dependencies between shown services."""
    shown = first_nodes(services, "name", limit)
    nodes = line(shown, F.col("name"), F.lit(""), F.concat(F.lit("    "), T.sanitize_id(F.col("name")), F.lit('["'), F.col("name"), F.lit("<br/>"), F.size("methods").cast("string"), F.lit(' methods"]')))
    edges = service_edges(shown).join(shown.select("project", F.col("name").alias("target")), ["project", "target"], "left_semi")
    return diagram("flowchart TB", nodes, line(edges, F.col("source"), F.col("target"), F.concat(F.lit("    "), T.sanitize_id(F.col("source")), F.lit(" --> "), T.sanitize_id(F.col("target"))), True))


def class_diagram(types: DataFrame, limit: int = 25) -> DataFrame:
    """Types with their fields, and an edge where a field has the type of another shown type."""
    shown = first_nodes(types.dropDuplicates(["project", "name"]), "name", limit)
    name = T.sanitize_id(F.col("name"))
    stereotype = lookup(STEREOTYPE, F.col("kind"), "")
    heads = line(shown.where(stereotype != ""), F.col("name"), F.lit("0"), F.concat(F.lit("    class "), name, stereotype))
    fields = shown.select("project", "name", F.posexplode("fields").alias("i", "f"))
    of_field = F.concat(F.lit("    "), name, F.lit(" : "), F.when(F.col("f.required"), "+").otherwise("-"), T.sanitize_id(F.coalesce("f.name", F.lit(""))), F.lit(" "), T.sanitize_type(F.coalesce("f.type", F.lit(""))))
    members = line(fields, F.col("name"), F.format_string("1%06d", "i"), of_field)
    targets = fields.select("project", "name", T.base_type(F.col("f.type")).alias("target")).where("target <> name").join(shown.select("project", F.col("name").alias("target")), ["project", "target"], "left_semi")
    edges = line(targets, F.col("name"), F.col("target"), F.concat(F.lit("    "), name, F.lit(" --> "), T.sanitize_id(F.col("target"))), True)
    return diagram("classDiagram\n    direction TB", heads.unionByName(members), edges)


def api_diagram(endpoints: DataFrame, limit: int = 20) -> DataFrame:
    """Endpoints (project, id, name, handlerClass, ...) by method, each with an edge to its handler."""
    shown = first_nodes(endpoints, "id", limit)
    method = F.coalesce("httpMethod", "operationType", F.lit("OTHER"))
    owner = F.coalesce("handlerClass", F.lit("undefined"))
    shown = shown.select("project", "id", method.alias("method"), owner.alias("owner"), T.sanitize_id(F.concat(owner, F.lit("_"), F.coalesce("name", F.lit("undefined")))).alias("node"), F.coalesce("path", "fieldName", "name").alias("label"))
    style = F.when(F.upper("method").isin("GET", "POST", "PUT", "DELETE", "PATCH"), F.concat(F.lit(":::"), F.lower("method"))).otherwise("")
    groups = shown.select("project", "method").distinct()
    inside = line(groups, F.col("method"), F.lit("0"), F.concat(F.lit("    subgraph "), F.col("method"), F.lit('["'), F.col("method"), F.lit('"]')))
    inside = inside.unionByName(line(shown, F.col("method"), F.concat(F.lit("1"), "id"), F.concat(F.lit("        "), F.col("node"), F.lit('["'), F.col("label"), F.lit('"]'), style)))
    inside = inside.unionByName(line(groups, F.col("method"), F.lit("2"), F.lit("    end")))
    handler = T.sanitize_id(F.concat(F.lit("handler_"), "owner"))
    handlers = line(shown.select("project", "owner").distinct(), F.col("owner"), F.lit(""), F.concat(F.lit("    "), handler, F.lit('(["'), F.col("owner"), F.lit('"])')))
    edges = line(shown, F.col("id"), F.lit(""), F.concat(F.lit("    "), F.col("node"), F.lit(" --> "), handler), True)
    return diagram("flowchart LR", inside, handlers, edges)


def sequence_diagram(endpoints: DataFrame, limit: int = 10) -> DataFrame:
    """Calls from a client over handlers to services and back, an endpoint after the other."""
    shown = first_nodes(endpoints, "id", limit)
    handler, service = T.sanitize_id(F.coalesce("handlerClass", F.lit("undefined"))), T.sanitize_id(F.col("serviceRef"))
    members = shown.select("project", handler.alias("n")).union(shown.where("serviceRef is not null").select("project", service)).distinct()
    heads = line(shown.select("project").distinct(), F.lit(""), F.lit(""), F.lit("    participant Client")).unionByName(line(members, F.lit("1"), F.col("n"), F.concat(F.lit("    participant "), "n")))
    text = lambda c: F.coalesce(F.col(c), F.lit("undefined"))
    method, place = F.coalesce("httpMethod", "operationType", F.lit("CALL")), F.coalesce("path", "fieldName", "name", F.lit("undefined"))
    steps = [(True, F.concat(F.lit("    Client->>+"), handler, F.lit(": "), method, F.lit(" "), place)), (False, F.concat(F.lit("    "), handler, F.lit("->>+"), service, F.lit(": "), text("handler"), F.lit("()"))), (False, F.concat(F.lit("    "), service, F.lit("-->>-"), handler, F.lit(": "), text("returnType"))), (True, F.concat(F.lit("    "), handler, F.lit("-->>-Client: "), F.when(F.col("httpMethod").isNotNull(), "200 OK").otherwise(text("returnType"))))]
    calls = None
    for i, (always, step) in enumerate(steps):
        one = line(shown if always else shown.where("serviceRef is not null"), F.col("id"), F.lit(str(i)), step, True)
        calls = one if calls is None else calls.unionByName(one)
    return diagram("sequenceDiagram", heads, calls)


def architecture_diagram(endpoints: DataFrame, services: DataFrame, entities: DataFrame, most_services: int = 15, most_entities: int = 10) -> DataFrame:
    """Layers: client, handling classes with their counts by protocol, services, entities, and the edges between them."""
    name = T.sanitize_id(F.col("name"))
    count = lambda p, label: F.when(F.count_if(F.col("protocol") == p) > 0, F.concat(F.lit("<br/>"), F.count_if(F.col("protocol") == p).cast("string"), F.lit(f" {label}"))).otherwise("")
    classes = endpoints.where("project is not null").groupBy("project", F.coalesce("handlerClass", F.lit("undefined")).alias("name")).agg(count("rest", "REST").alias("rest"), count("graphql", "GraphQL").alias("graphql"))

    def layer(df: DataFrame, title: str, text: Column) -> DataFrame:
        own = df.select("project").distinct()
        return line(own, F.lit("0"), F.lit(""), F.lit(f"    subgraph {title}")).unionByName(line(df, F.lit("1"), F.col("name"), text)).unionByName(line(own, F.lit("2"), F.lit(""), F.lit("    end")))

    client = layer(classes.select("project").distinct().withColumn("name", F.lit("CLIENT")), 'Client["Client Layer"]', F.lit('        CLIENT["Client / Browser"]'))
    api = layer(classes, 'API["API Layer"]', F.concat(F.lit("        "), name, F.lit('["'), "name", "rest", "graphql", F.lit('"]')))
    logic = layer(first_nodes(services, "name", most_services), 'Services["Service Layer"]', F.concat(F.lit("        "), name, F.lit('["'), "name", F.lit("<br/>"), F.size("methods").cast("string"), F.lit(' methods"]')))
    data = layer(first_nodes(entities, "name", most_entities), 'Data["Data Layer"]', F.concat(F.lit("        "), name, F.lit('[("'), "name", F.lit("<br/>"), "tableName", F.lit('")]')))
    calls = line(classes, F.col("name"), F.lit(""), F.concat(F.lit("    CLIENT --> "), name), True)
    refs = endpoints.where("serviceRef is not null and project is not null").select("project", T.sanitize_id(F.coalesce("handlerClass", F.lit("undefined"))).alias("s"), T.sanitize_id(F.col("serviceRef")).alias("t")).distinct()
    held = service_edges(services).join(entities.select("project", F.col("name").alias("target")), ["project", "target"], "left_semi").select("project", T.sanitize_id(F.col("source")).alias("s"), T.sanitize_id(F.col("target")).alias("t"))
    edge = lambda df: line(df, F.col("s"), F.col("t"), F.concat(F.lit("    "), "s", F.lit(" --> "), "t"), True)
    return diagram("flowchart TB", client, api, logic, data, calls, edge(refs), edge(held))


def dependency_diagram(edges: DataFrame, nodes: DataFrame, limit: int = 80) -> DataFrame:
    """The first ``limit`` edges (project, source, target) with their nodes (project, node, module) by module."""
    shown = edges.withColumn("_n", F.row_number().over(Window.partitionBy("project").orderBy("source", "target"))).where(F.col("_n") <= limit).drop("_n")
    ends = shown.select("project", F.col("source").alias("node")).union(shown.select("project", "target")).distinct().join(nodes.select("project", "node", "module"), ["project", "node"], "left").withColumn("module", F.coalesce("module", F.lit("other")))
    groups = ends.select("project", "module").distinct()
    inside = line(groups, F.col("module"), F.lit("0"), F.concat(F.lit("    subgraph "), T.sanitize_id(F.col("module")), F.lit('["'), "module", F.lit('"]')))
    inside = inside.unionByName(line(ends, F.col("module"), F.concat(F.lit("1"), "node"), F.concat(F.lit("        "), T.sanitize_id(F.col("node")), F.lit('["'), "node", F.lit('"]')))).unionByName(line(groups, F.col("module"), F.lit("2"), F.lit("    end")))
    return diagram("flowchart LR", inside, line(shown, F.col("source"), F.col("target"), F.concat(F.lit("    "), T.sanitize_id(F.col("source")), F.lit(" -.-> "), T.sanitize_id(F.col("target"))), True))


def domains(endpoints: DataFrame, entities: DataFrame, least: int = 2) -> DataFrame:
    """(project, domain, endpoints, entities): endpoints by the first segment of their path, each entity in the first domain by name that holds its name or that it holds, else in its own; domains with fewer than ``least`` members fold into ``Other``."""
    first = F.coalesce(F.nullif(F.get(F.filter(F.split(F.coalesce("path", "fieldName", F.lit("")), "/"), lambda x: F.length(x) > 0), 0), F.lit("")), F.lit("Other"))
    groups = endpoints.where("project is not null").groupBy("project", T.capitalize(first).alias("domain")).agg(F.count("*").alias("endpoints"))
    names = entities.select("project", "name").distinct().withColumn("low", F.lower("name"))
    known = groups.select("project", "domain").withColumn("low", F.lower("domain"))
    words, parts = names.select(F.col("low").alias("word")).distinct(), known.select(F.col("low").alias("part")).distinct()
    holds = _inside_pairs(words, parts).select(F.col("word").alias("name_low"), F.col("part").alias("domain_low"))
    held = _inside_pairs(parts.withColumnRenamed("part", "word"), words.withColumnRenamed("word", "part")).select(F.col("part").alias("name_low"), F.col("word").alias("domain_low"))
    met = names.withColumnRenamed("low", "name_low").join(holds.unionByName(held).distinct(), "name_low").join(known.withColumnRenamed("low", "domain_low"), ["project", "domain_low"]).groupBy("project", "name").agg(F.min("domain").alias("domain"))
    placed = names.join(met, ["project", "name"], "left").select("project", F.coalesce("domain", T.capitalize(F.col("name"))).alias("domain")).groupBy("project", "domain").agg(F.count("*").alias("entities"))
    both = groups.join(placed, ["project", "domain"], "full_outer").fillna(0, ["endpoints", "entities"])
    folded = F.when(F.col("endpoints") + F.col("entities") >= least, F.col("domain")).otherwise("Other")
    return both.groupBy("project", folded.alias("domain")).agg(F.sum("endpoints").alias("endpoints"), F.sum("entities").alias("entities"))


def props_of(types: DataFrame) -> DataFrame:
    """(project, component, props): the type of a component's properties, ``NameProps`` before ``NameProperty``."""
    names = types.select("project", F.col("name").alias("component")).where("component is not null").distinct()
    props = names.select("project", F.col("component").alias("props"), F.explode(F.array(F.struct(F.lit(0).alias("order"), F.lit("Props").alias("end")), F.struct(F.lit(1).alias("order"), F.lit("Property").alias("end")))).alias("e"))
    props = props.where(F.endswith("props", F.col("e.end"))).select("project", "props", "e.order", F.expr("substr(props, 1, length(props) - length(e.end))").alias("component"))
    return names.join(props, ["project", "component"]).groupBy("project", "component").agg(F.min_by("props", "order").alias("props"))


def common_folder(paths: DataFrame, group: str = "repo", path: str = "path") -> DataFrame:
    """(group, folder): the longest folder that all paths of a group share; that of its smallest and its largest path, so that only these two leave each task."""
    ends = paths.where(F.col(path).isNotNull()).groupBy(group).agg(F.split(F.min(path), "/").alias("a"), F.split(F.max(path), "/").alias("b"))
    least = F.least(F.size("a"), F.size("b")) - 1
    same = F.filter(F.sequence(F.lit(0), F.greatest(least, F.lit(0))), lambda n: (n <= least) & (F.slice("a", 1, n) == F.slice("b", 1, n)))
    return ends.select(group, F.array_join(F.slice("a", 1, F.array_max(same)), "/").alias("folder"))


def merged_fields(types: DataFrame, group: str = "repo") -> DataFrame:
    """(group, name, field, type, place): of types of one name the first by ``type_id``, then the fields that later ones have besides."""
    rows = types.where("name is not null").select(group, "name", "type_id", F.posexplode("fields").alias("i", "f"))
    first = rows.where("f.name is not null").groupBy(group, "name", F.col("f.name").alias("field")).agg(F.min_by("f.type", F.struct("type_id", "i")).alias("type"), F.min(F.struct("type_id", "i")).alias("at"))
    place = F.row_number().over(Window.partitionBy(group, "name").orderBy("at"))
    return first.select(group, "name", "field", "type", place.alias("place"))
