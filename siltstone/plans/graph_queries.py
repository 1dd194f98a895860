"""Queries on the graph of each project's last version, and figures of its architecture, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import collections, graph, versions
from ..tables import read
from .base import Book
from .search_queries import LAST

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle

ID = "case when protocol = 'rest' then coalesce(httpMethod, 'undefined') || ':' || coalesce(path, 'undefined') when protocol = 'graphql' then coalesce(operationType, 'undefined') || ':' || coalesce(fieldName, 'undefined') else coalesce(name, 'undefined') end"
BASE = LAST + f"""
eps as (select *, {ID} as id from held),
svc as (select project, handlerClass as name, list_sort(list_distinct(list(name))) as methods, list_sort(list_distinct(list(serviceRef) filter (serviceRef is not null))) as deps from held where handlerClass is not null group by all),
dep as (select distinct project, handlerClass as source, serviceRef as target from held where handlerClass is not null and serviceRef is not null),
ent_rows as (select project, regexp_replace(serviceRef, 'Service$', '') as name, parameters, returnType from held where serviceRef is not null),
ent as (select distinct project, name from ent_rows),
cols as (select project, name, p.name as col, min(p.type) as type from (select project, name, unnest(parameters) as p from ent_rows) where p.name is not null group by all),
rels as (select project, name, regexp_replace(returnType, '(\\[\\])+$', '') as target, case when bool_or(ends_with(returnType, '[]')) then 'OneToMany' else 'ManyToOne' end as type from ent_rows where returnType is not null group by all)
"""


def last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, snapshot_no, id, item) of the last version of each project."""
    endpoints = read(spark, sf_dir, "endpoints")
    held = versions.items(endpoints, versions.endpoint_id(), (*collections.COLUMNS, "filePath", "tags", "description"))
    return held.join(versions.versions(endpoints).where("next is null"), [*versions.AT], "left_semi")


def _flat(held: DataFrame) -> DataFrame:
    return held.select("project", "id", "item.*")


INSIDE = "contains(d.dep, e.name) or contains(e.name, d.dep)"


def _entity_services_sql(dep: str) -> str:
    return BASE + f", d as (select project, source as service, {dep} as dep from dep where {dep} <> '') select distinct project, entity, service from (select d.project, d.service, d.dep, min(e.name) as entity from d join ent e on d.project = e.project and ({INSIDE}) group by all)"


@BOOK.query(_entity_services_sql("target"))
def graph_entity_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services by the entity that their dependencies name."""
    held = last(spark, sf_dir)
    return graph.entity_services(collections.services(held), collections.entities(held))


@BOOK.query(_entity_services_sql("regexp_replace(target, '(Repository|Service)$', '')"))
def graph_data_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the ends of the dependencies' names."""
    held = last(spark, sf_dir)
    return graph.entity_services(collections.services(held), collections.entities(held), strip=True)


@BOOK.query(BASE + "select * from (select project, entity, service, endpoint, row_number() over (partition by project order by entity, service, endpoint)::int as rank from (select distinct e.project, e.name as entity, h.serviceRef as service, h.id as endpoint from ent e join eps h on e.project = h.project and h.serviceRef = e.name || 'Service')) where rank <= 10")
def graph_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from entities over services to endpoints, ten of each project."""
    held = last(spark, sf_dir)
    return graph.flows(collections.entities(held), _flat(held))


@BOOK.query(BASE + "select project, source, target, exists (select 1 from svc s where s.project = dep.project and s.name = dep.target) as known from dep")
def graph_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of services, and whether they are services themselves."""
    services = collections.services(last(spark, sf_dir))
    known = services.select("project", F.col("name").alias("target"), F.lit(True).alias("known")).distinct()
    return graph.service_edges(services).join(known, ["project", "target"], "left").select("project", "source", "target", F.coalesce("known", F.lit(False)).alias("known"))


@BOOK.query(BASE + "select project, node, sum(u)::bigint as uses, sum(v)::bigint as used_by from (select project, source as node, 1 as u, 0 as v from dep union all select project, target, 0, 1 from dep) group by all")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many others each node uses and is used by."""
    return graph.degrees(graph.service_edges(collections.services(last(spark, sf_dir))))


PARENT = "case when len(string_split({0}, '/')) >= 2 then string_split({0}, '/')[-2] else 'root' end"


@BOOK.query(
    BASE + f""", nodes as (select project, source as node from dep union select project, target from dep union select repo, name from type_infos where repo is not null and name is not null),
sp as (select project, handlerClass as node, min(filePath) as p from held where handlerClass is not null and filePath is not null group by all), tp as (select repo as project, name as node, min(filePath) as p from type_infos where filePath is not null group by all),
ep as (select project, regexp_replace(serviceRef, 'Service$', '') as node, min(filePath) as p from held where serviceRef is not null and filePath is not null group by all)
select project, node, case when tp.p is not null then {PARENT.format('tp.p')} when sp.p is not null then {PARENT.format('sp.p')} when ep.p is not null then {PARENT.format('ep.p')} else 'other' end as module,
case when ep.p is not null then 'entity' when sp.p is not null then 'service' when exists (select 1 from type_infos t where t.repo = nodes.project and t.name = nodes.node and t.kind = 'enum') then 'enum' else 'plain' end as shape
from nodes left join tp using (project, node) left join sp using (project, node) left join ep using (project, node)"""
)
def graph_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module and shape of every node."""
    held = last(spark, sf_dir)
    flat = _flat(held)
    edges = graph.service_edges(collections.services(held))
    types = read(spark, sf_dir, "type_infos").select(F.col("repo").alias("project"), "name", "kind", F.col("filePath").alias("path"))
    nodes = edges.select("project", F.col("source").alias("node")).union(edges.select("project", "target")).union(types.where("project is not null and name is not null").select("project", "name"))
    entities = flat.where("serviceRef is not null").select("project", F.regexp_replace("serviceRef", "Service$", "").alias("name"), F.col("filePath").alias("path"))
    services = flat.where("handlerClass is not null").select("project", F.col("handlerClass").alias("name"), F.col("filePath").alias("path"))
    return graph.modules(nodes, entities, services, types)


TOP = "{0} as (select * from {1} where project is not null qualify row_number() over (partition by project order by {2}) <= {3})"
SAFE = "regexp_replace({0}, '[^a-zA-Z0-9_]', '_', 'g')"
TYPE = "regexp_replace(coalesce({0}, ''), '[<>\\[\\]{{}}\\s]', '_', 'g')"
CODE = "select project, '{0}' || chr(10) || string_agg(line, chr(10) order by part, a, b, line) as code, sum(edge)::bigint as edges from ls group by project"


@BOOK.query(
    BASE + ", " + TOP.format("n", "ent", "name", 30) + f""", body as (select project, name, string_agg('        ' || {TYPE.format('type')} || ' ' || {SAFE.format('col')} || chr(10), '' order by col) as b from cols group by all),
ls as (select n.project, 0 as part, n.name as a, '' as b, '    ' || {SAFE.format('n.name')} || ' {{' || chr(10) || coalesce(body.b, '') || '    }}' as line, 0 as edge from n left join body using (project, name)
union all select r.project, 1, r.name, r.target, '    ' || {SAFE.format('r.name')} || case r.type when 'OneToMany' then ' ||--o{{ ' else ' }}o--|| ' end || {SAFE.format('r.target')} || ' : "' || r.type || '"', 1 from rels r join n on r.project = n.project and r.name = n.name where exists (select 1 from n m where m.project = r.project and m.name = r.target)) """.replace("{{", "{").replace("}}", "}")
    + CODE.format("erDiagram")
)
def diagram_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity diagram of each project."""
    return graph.er_diagram(collections.entities(last(spark, sf_dir)))


@BOOK.query(
    BASE + ", " + TOP.format("n", "svc", "name", 30) + f""", ls as (select project, 0 as part, name as a, '' as b, '    ' || {SAFE.format('name')} || '["' || name || '<br/>' || len(methods) || ' methods"]' as line, 0 as edge from n
union all select project, 1, name, d, '    ' || {SAFE.format('name')} || ' --> ' || {SAFE.format('d')}, 1 from (select project, name, unnest(deps) as d from n) x where exists (select 1 from n m where m.project = x.project and m.name = x.d)) """
    + CODE.format("flowchart TB")
)
def diagram_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow chart of each project's services."""
    return graph.service_diagram(collections.services(last(spark, sf_dir)))


@BOOK.query(
    BASE + ", " + TOP.format("n", "eps", "id", 20) + f""", m as (select project, id, coalesce(httpMethod, operationType, 'OTHER') as method, coalesce(handlerClass, 'undefined') as owner, {SAFE.format("(coalesce(handlerClass, 'undefined') || '_' || coalesce(name, 'undefined'))")} as node, coalesce(path, fieldName, name) as label from n),
g as (select distinct project, method from m),
ls as (select project, 0 as part, method as a, '0' as b, '    subgraph ' || method || '["' || method || '"]' as line, 0 as edge from g
union all select project, 0, method, '1' || id, '        ' || node || '["' || label || '"]' || case when upper(method) in ('GET', 'POST', 'PUT', 'DELETE', 'PATCH') then ':::' || lower(method) else '' end, 0 from m
union all select project, 0, method, '2', '    end', 0 from g
union all select distinct project, 1, owner, '', '    ' || {SAFE.format("('handler_' || owner)")} || '(["' || owner || '"])', 0 from m
union all select project, 2, id, '', '    ' || node || ' --> ' || {SAFE.format("('handler_' || owner)")}, 1 from m) """
    + CODE.format("flowchart LR")
)
def diagram_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow chart of each project's endpoints and handlers."""
    return graph.api_diagram(_flat(last(spark, sf_dir)))


@BOOK.query(
    "with d as (select repo as project, name, kind, fields from type_infos where repo is not null and name is not null qualify row_number() over (partition by repo, name order by type_id) = 1), "
    + TOP.format("n", "d", "name", 25)
    + f""", f as (select project, name, f.name as fname, f.type as ftype, f.required as req, i - 1 as i from (select project, name, unnest(fields) as f, generate_subscripts(fields, 1) as i from n)),
t as (select project, name, regexp_extract(ftype, '(?:\\w+<)?(\\w+)>?', 1) as target from f),
ls as (select project, 0 as part, name as a, '0' as b, '    class ' || {SAFE.format('name')} || case kind when 'interface' then '~interface~' when 'enum' then '~enumeration~' when 'dto' then '~DTO~' when 'input' then '~input~' when 'response' then '~response~' end as line, 0 as edge from n where kind in ('interface', 'enum', 'dto', 'input', 'response')
union all select project, 0, name, printf('1%06d', i), '    ' || {SAFE.format('name')} || ' : ' || case when req then '+' else '-' end || {SAFE.format("coalesce(fname, '')")} || ' ' || {TYPE.format('ftype')}, 0 from f
union all select project, 1, name, target, '    ' || {SAFE.format('name')} || ' --> ' || {SAFE.format('target')}, 1 from t where target <> name and exists (select 1 from n m where m.project = t.project and m.name = t.target)) """.replace("{{", "{").replace("}}", "}")
    + CODE.format("classDiagram' || chr(10) || '    direction TB")
)
def diagram_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class diagram of each project's types."""
    types = read(spark, sf_dir, "type_infos").where("repo is not null and name is not null")
    first = F.row_number().over(Window.partitionBy("repo", "name").orderBy("type_id"))
    return graph.class_diagram(types.withColumn("_first", first).where("_first = 1").select(F.col("repo").alias("project"), "name", "kind", "fields"))


@BOOK.query(
    BASE + """select project, metric, value from (select project, count(*) as endpoints, count(distinct protocol) as protocols, count(*) filter (auth) as auth_required, count(*) filter (deprecated) as deprecated, count(distinct handlerClass) as services,
count(distinct serviceRef) as entities, count(distinct (handlerClass, serviceRef)) filter (handlerClass is not null and serviceRef is not null) as dependencies from held group by project) unpivot (value for metric in (endpoints, protocols, auth_required, deprecated, services, entities, dependencies))"""
)
def arch_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each project's collections."""
    flat = _flat(last(spark, sf_dir))
    counts = flat.groupBy("project").agg(
        F.count("*").alias("endpoints"), F.countDistinct("protocol").alias("protocols"), F.count_if("auth").alias("auth_required"), F.count_if("deprecated").alias("deprecated"),
        F.countDistinct("handlerClass").alias("services"), F.countDistinct("serviceRef").alias("entities"), F.countDistinct("handlerClass", "serviceRef").alias("dependencies"),
    )
    return counts.unpivot("project", [c for c in counts.columns if c != "project"], "metric", "value")


@BOOK.query(BASE + "select project, protocol, n as endpoints, printf('%.1f', round(100.0::double * n / sum(n) over (partition by project), 1)) as percent from (select project, upper(coalesce(protocol, 'unknown')) as protocol, count(*) as n from held group by all)")
def arch_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each protocol in each project."""
    counts = _flat(last(spark, sf_dir)).groupBy("project", F.upper(F.coalesce("protocol", F.lit("unknown"))).alias("protocol")).agg(F.count("*").alias("endpoints"))
    whole = F.sum("endpoints").over(Window.partitionBy("project"))  # a row per protocol
    return counts.withColumn("percent", F.format_string("%.1f", F.round(100.0 * F.col("endpoints") / whole, 1)))


@BOOK.query(
    """select repo, case when regexp_matches(name, '^use[A-Z]') then 'hook' when ends_with(name, 'Provider') then 'provider' when ends_with(name, 'Layout') then 'layout' else 'component' end as badge,
case when len(string_split(filePath, '/')) >= 2 then string_split(filePath, '/')[-2] else 'root' end as folder, count(*) as components from type_infos
where kind not in ('enum', 'dto', 'input', 'response') and not regexp_matches(name, '(Props|DTO|Dto|Request|Response|Input|Args)$') and regexp_matches(name, '^[A-Z]') group by all"""
)
def arch_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by badge and folder: types that are no inputs, enums and the like."""
    name = F.col("name")
    types = read(spark, sf_dir, "type_infos").where(~F.col("kind").isin("enum", "dto", "input", "response") & ~name.rlike("(Props|DTO|Dto|Request|Response|Input|Args)$") & name.rlike("^[A-Z]"))
    badge = F.when(name.rlike("^use[A-Z]"), "hook").when(name.endswith("Provider"), "provider").when(name.endswith("Layout"), "layout").otherwise("component")
    return types.groupBy("repo", badge.alias("badge"), T.module_of(F.col("filePath")).alias("folder")).agg(F.count("*").alias("components"))


@BOOK.query(
    "select repo, folder, string_agg(path, ',' order by path) as files from (select distinct repo, path, regexp_replace(path, '/[^/]*$', '') as folder from source_files where regexp_matches(path, '(?i)route|page|screen|controller') qualify row_number() over (partition by repo, folder order by path) <= 10) group by all"
)
def arch_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route files by folder, ten of each."""
    files = read(spark, sf_dir, "source_files").where(F.col("path").rlike("(?i)route|page|screen|controller")).select("repo", "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    rank = F.row_number().over(Window.partitionBy("repo", "folder").orderBy("path"))
    return files.withColumn("rank", rank).where("rank <= 10").groupBy("repo", "folder").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"))


@BOOK.query(
    """with p as (select repo, file_id, string_split(replace(lower(regexp_extract(path, '([^/]*)\\.c$', 1)), '-', '_'), '.') as x, regexp_extract_all(content, '(?m)^(?:static )?\\w+ \\*?(\\w+)\\(', 1) as fs from source_files where path like '%.c'),
f as (select distinct repo, unnest(fs) as f from p), s as (select repo, f, string_split(f, '_') as parts from f),
e as (select repo, f, list_aggregate(parts[1:i], 'string_agg', '_') as prefix from (select *, unnest(range(1, len(parts))) as i from s))
select repo, prefix, count(distinct f) as functions from e where prefix <> '' group by all having count(distinct f) >= 3"""
)
def group_prefix_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of C functions: every prefix of names up to an underscore that three functions share."""
    files = read(spark, sf_dir, "source_files").where("path like '%.c'")
    names = files.select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(?:static )?\w+ \*?(\w+)\("), 1)).alias("f")).distinct()
    parts = F.split("f", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "_"))
    found = names.where(F.contains("f", F.lit("_"))).select("repo", "f", F.explode(prefixes).alias("prefix")).where("prefix <> ''")
    return found.groupBy("repo", "prefix").agg(F.countDistinct("f").alias("functions")).where("functions >= 3")
