"""Queries that compare the delivered versions of each project's analysis, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collections, versions
from ..tables import read
from .base import Book

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle

BASE = """
with held as (select * from (select *,
    case when protocol = 'rest' then coalesce(httpMethod, 'undefined') || ':' || coalesce(path, 'undefined')
         when protocol = 'graphql' then coalesce(operationType, 'undefined') || ':' || coalesce(fieldName, 'undefined') else coalesce(name, 'undefined') end as id
  from endpoints where project is not null and snapshot_no is not null)
  qualify row_number() over (partition by project, snapshot_no, id order by received_at desc nulls last, row_id desc) = 1),
del as (select project, snapshot_no, lead(snapshot_no) over (partition by project order by snapshot_no) as nxt, min(snapshot_no) over (partition by project) as fst
  from (select distinct project, snapshot_no from endpoints where project is not null and snapshot_no is not null)),
"""
FLAT = """
{0}_all as (select project, snapshot_no, id, x.* from (select project, snapshot_no, id, unnest(xs) as x, generate_subscripts(xs, 1) as pos from ({1})) qualify row_number() over (partition by project, snapshot_no, id, x.{2} order by pos desc) = 1),
{0} as (select coalesce(c.project, o.project) as project, coalesce(c.snapshot_no, o.snapshot_no) as snapshot_no, coalesce(c.id, o.id) as id, coalesce(c.{2}, o.{2}) as name, {3},
    case when o.id is null then 'added' when c.id is null then 'removed' when {4} then 'modified' else 'unchanged' end as status
  from (select a.* from {0}_all a join del using (project, snapshot_no) where snapshot_no > fst) c
  full join (select a.* replace (nxt as snapshot_no) from {0}_all a join del using (project, snapshot_no) where nxt is not null) o on c.project = o.project and c.snapshot_no = o.snapshot_no and c.id = o.id and c.{2} is not distinct from o.{2}),
"""


def flat_sql(name: str, source: str, key: str, fields: tuple[str, ...]) -> str:
    sides = ", ".join(f"o.{f} as prev_{f}, c.{f} as curr_{f}" for f in fields)
    changed = " or ".join(f"c.{f} is distinct from o.{f}" for f in fields)
    return FLAT.format(name, source, key, sides, changed)


ITEMS = """
{0} as (select coalesce(c.project, o.project) as project, coalesce(c.snapshot_no, o.snapshot_no) as snapshot_no, coalesce(c.id, o.id) as id, c as new, o as old,
    case when o.id is null then 'added' when c.id is null then 'removed' when {2} or n.id is not null then 'modified' else 'unchanged' end as status
  from (select a.* from {1} a join del using (project, snapshot_no) where snapshot_no > fst) c
  full join (select a.* replace (nxt as snapshot_no) from {1} a join del using (project, snapshot_no) where nxt is not null) o on c.project = o.project and c.snapshot_no = o.snapshot_no and c.id = o.id
  left join (select distinct project, snapshot_no, id from ({3}) where status <> 'unchanged') n on n.project = coalesce(c.project, o.project) and n.snapshot_no = coalesce(c.snapshot_no, o.snapshot_no) and n.id = coalesce(c.id, o.id)),
"""


def items_sql(name: str, source: str, fields: tuple[str, ...], nests: tuple[str, ...]) -> str:
    changed = " or ".join(f"c.{f} is distinct from o.{f}" for f in fields) or "false"
    return ITEMS.format(name, source, changed, " union all ".join(f"select project, snapshot_no, id, status from {n}" for n in nests))


ENDPOINTS = flat_sql("params", "select project, snapshot_no, id, parameters as xs from held", "name", versions.PARAMETER) + items_sql("eps", "held", versions.ENDPOINT, ("params",))
SERVICES = """
svc as (select project, snapshot_no, handlerClass as id, list_sort(list_distinct(list(name))) as methods, coalesce(list_sort(list_distinct(list(serviceRef) filter (serviceRef is not null))), []) as dependencies from held where handlerClass is not null group by all),
svcs as (select coalesce(c.project, o.project) as project, coalesce(c.snapshot_no, o.snapshot_no) as snapshot_no, coalesce(c.id, o.id) as id, c as new, o as old,
    case when o.id is null then 'added' when c.id is null then 'removed' when c.methods is distinct from o.methods or c.dependencies is distinct from o.dependencies then 'modified' else 'unchanged' end as status
  from (select a.* from svc a join del using (project, snapshot_no) where snapshot_no > fst) c
  full join (select a.* replace (nxt as snapshot_no) from svc a join del using (project, snapshot_no) where nxt is not null) o on c.project = o.project and c.snapshot_no = o.snapshot_no and c.id = o.id),
"""
ENTITIES = (
    """
ent_rows as (select project, snapshot_no, regexp_replace(serviceRef, 'Service$', '') as id, parameters, returnType from held where serviceRef is not null),
cols as (select project, snapshot_no, id, p.name as name, min(p.type) as type, not bool_or(coalesce(p.required, false)) as nullable from (select project, snapshot_no, id, unnest(parameters) as p from ent_rows) where p.name is not null group by all),
rels as (select project, snapshot_no, id, regexp_replace(returnType, '(\\[\\])+$', '') as target, case when bool_or(ends_with(returnType, '[]')) then 'OneToMany' else 'ManyToOne' end as type from ent_rows where returnType is not null group by all),
ent as (select distinct project, snapshot_no, id, lower(id) || 's' as tableName from ent_rows),
"""
    + flat_sql("columns_", "select project, snapshot_no, id, list({name: name, type: type, nullable: nullable}) as xs from cols group by all", "name", versions.COLUMN)
    + flat_sql("relations_", "select project, snapshot_no, id, list({target: target, type: type}) as xs from rels group by all", "target", versions.RELATION)
    + items_sql("ents", "ent", versions.ENTITY, ("columns_", "relations_"))
)
TYPES = (
    """
typ as (select project, snapshot_no, handler || 'Input' as id, 'input' as kind, parameters as xs from held where handler is not null and len(parameters) > 0 qualify row_number() over (partition by project, snapshot_no, handler order by held.id desc) = 1),
"""
    + flat_sql("fields_", "select project, snapshot_no, id, list_transform(xs, lambda x: {name: x.name, type: x.type, required: x.required}) as xs from typ", "name", versions.FIELD)
    + items_sql("types_", "typ", versions.TYPE, ("fields_",))
)
END = "done as (select 1) "


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "endpoints")


def _compared(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    endpoints = _endpoints(spark, sf_dir)
    held, delivered = collections.held(endpoints), versions.versions(endpoints)
    return {
        "endpoint": versions.compare_endpoints(endpoints), "entity": versions.compare_entities(collections.entities(held), delivered),
        "type": versions.compare_types(collections.types(held), delivered), "service": versions.compare_services(collections.services(held), delivered),
    }


@BOOK.query(BASE + ENDPOINTS + END + "select project, snapshot_no, id, status, new.returnType is distinct from old.returnType as return_type_changed, new.handler is distinct from old.handler as handler_changed, new.auth is distinct from old.auth as auth_changed, new.deprecated is distinct from old.deprecated as deprecated_changed from eps")
def version_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints of consecutive versions, unchanged ones too, with what changed."""
    df = versions.compare_endpoints(_endpoints(spark, sf_dir))
    flag = lambda f, name: versions.differs(F.col(f"old.{f}"), F.col(f"new.{f}")).alias(name)
    return df.select(*versions.AT, "id", "status", flag("returnType", "return_type_changed"), flag("handler", "handler_changed"), flag("auth", "auth_changed"), flag("deprecated", "deprecated_changed"))


@BOOK.query(BASE + ENDPOINTS + END + "select project, snapshot_no, id, name, status, prev_type, curr_type, prev_required, curr_required, prev_location, curr_location from params where status <> 'unchanged'")
def version_endpoint_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that were added, removed or changed."""
    df = versions.compare_endpoints(_endpoints(spark, sf_dir))
    return df.select(*versions.AT, "id", F.explode("params").alias("p")).select(*versions.AT, "id", "p.*")


@BOOK.query(BASE + SERVICES + END + "select project, snapshot_no, id, status, list_aggregate(list_sort(list_filter(coalesce(new.methods, []), lambda x: not list_contains(coalesce(old.methods, []), x))), 'string_agg', ',') as methods_added, list_aggregate(list_sort(list_filter(coalesce(old.methods, []), lambda x: not list_contains(coalesce(new.methods, []), x))), 'string_agg', ',') as methods_removed from svcs")
def version_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of consecutive versions with the methods that came and went."""
    df = _compared(spark, sf_dir)["service"]
    text = lambda c: F.nullif(F.concat_ws(",", c), F.lit(""))
    return df.select(*versions.AT, "id", "status", text("methodsAdded").alias("methods_added"), text("methodsRemoved").alias("methods_removed"))


@BOOK.query(BASE + ENTITIES + END + "select project, snapshot_no, id, status from ents")
def version_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of consecutive versions."""
    return _compared(spark, sf_dir)["entity"].select(*versions.AT, "id", "status")


@BOOK.query(BASE + ENTITIES + END + "select project, snapshot_no, id, name, status, prev_type, curr_type, prev_nullable, curr_nullable from columns_ where status <> 'unchanged'")
def version_entity_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of entities that were added, removed or changed."""
    df = _compared(spark, sf_dir)["entity"]
    return df.select(*versions.AT, "id", F.explode("columnChanges").alias("c")).select(*versions.AT, "id", "c.*")


@BOOK.query(BASE + ENTITIES + END + "select project, snapshot_no, id, name, status, prev_type, curr_type from relations_ where status <> 'unchanged'")
def version_entity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of entities that were added, removed or changed."""
    df = _compared(spark, sf_dir)["entity"]
    return df.select(*versions.AT, "id", F.explode("relationChanges").alias("c")).select(*versions.AT, "id", "c.*")


@BOOK.query(BASE + TYPES + END + "select project, snapshot_no, id, status from types_")
def version_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input types of consecutive versions."""
    return _compared(spark, sf_dir)["type"].select(*versions.AT, "id", "status")


@BOOK.query(BASE + TYPES + END + "select project, snapshot_no, id, name, status, prev_type, curr_type, prev_required, curr_required from fields_ where status <> 'unchanged'")
def version_type_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of types that were added, removed or changed."""
    df = _compared(spark, sf_dir)["type"]
    return df.select(*versions.AT, "id", F.explode("fieldChanges").alias("c")).select(*versions.AT, "id", "c.*")


COUNTS = "select project, snapshot_no, '{1}' as category, count(*) filter (status = 'added') as added, count(*) filter (status = 'removed') as removed, count(*) filter (status = 'modified') as modified, count(*) filter (status = 'unchanged') as unchanged from {0} group by all"


@BOOK.query(BASE + ENDPOINTS + SERVICES + ENTITIES + TYPES + END + " union all ".join(COUNTS.format(t, c) for t, c in (("eps", "endpoint"), ("ents", "entity"), ("types_", "type"), ("svcs", "service"))))
def version_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status of the four collections in every version."""
    return versions.summary(_compared(spark, sf_dir))


@BOOK.query(
    BASE + ENDPOINTS + ENTITIES + TYPES + END
    + """, mod as (select project, snapshot_no, id, new.name as owner from eps where status = 'modified'),
pc as (select p.*, m.owner from params p join mod m using (project, snapshot_no, id)),
cc as (select c.* from columns_ c join (select project, snapshot_no, id from ents where status = 'modified') using (project, snapshot_no, id))
select project, snapshot_no, 'critical' as severity, 'endpoint' as category, old.name as name, 'Endpoint removed: ' || coalesce(old.httpMethod, old.operationType, upper(old.protocol), 'undefined') || ' ' || coalesce(old.path, old.fieldName, '') as reason from eps where status = 'removed'
union all select project, snapshot_no, 'warning', 'endpoint', new.name, 'Return type changed: ' || coalesce(old.returnType, 'undefined') || ' → ' || coalesce(new.returnType, 'undefined') from eps where status = 'modified' and old.returnType is distinct from new.returnType
union all select project, snapshot_no, 'critical', 'endpoint', owner, 'New required parameter: ' || coalesce(name, 'undefined') || ' (' || coalesce(curr_type, 'undefined') || ')' from pc where status = 'added' and curr_required
union all select project, snapshot_no, 'warning', 'endpoint', owner, 'Parameter removed: ' || coalesce(name, 'undefined') from pc where status = 'removed'
union all select project, snapshot_no, 'critical', 'endpoint', owner, 'Parameter became required: ' || coalesce(name, 'undefined') from pc where status = 'modified' and not coalesce(prev_required, false) and curr_required
union all select project, snapshot_no, 'critical', 'entity', id, 'Entity/table removed' from ents where status = 'removed'
union all select project, snapshot_no, 'warning', 'entity', id, 'Column removed: ' || coalesce(name, 'undefined') from cc where status = 'removed'
union all select project, snapshot_no, 'warning', 'entity', id, 'Column nullability changed: ' || coalesce(name, 'undefined') from cc where status = 'modified' and prev_nullable is distinct from curr_nullable
union all select project, snapshot_no, 'warning', 'type', id, 'Type removed' from types_ where status = 'removed'"""
)
def version_breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that break callers."""
    found = _compared(spark, sf_dir)
    return versions.breaking(found["endpoint"], found["entity"], found["type"])


PRINT = "list_sort(list_transform(coalesce({0}.parameters, []), lambda p: coalesce(p.name, 'undefined') || ':' || coalesce(p.type, 'undefined') || ':' || coalesce(p.required::varchar, 'undefined')))"
PLACE = "case when {0}.protocol = 'rest' then coalesce({0}.httpMethod, 'undefined') || ' ' || coalesce({0}.path, 'undefined') when {0}.protocol = 'graphql' then coalesce({0}.operationType, 'undefined') || ' ' || coalesce({0}.fieldName, 'undefined') else {0}.name end"
LOG = (
    BASE + ENDPOINTS + SERVICES + ENTITIES + f"""
ncol as (select project, snapshot_no, id, count(*) as n, list_sort(list(name || ':' || coalesce(type, 'undefined') || ':' || nullable::varchar)) as prints from cols group by all),
nrel as (select project, snapshot_no, id, count(*) as n from rels group by all),
entc as (select e.*, coalesce(c.n, 0) as nc, coalesce(c.prints, []) as prints, coalesce(r.n, 0) as nr from ent e left join ncol c using (project, snapshot_no, id) left join nrel r using (project, snapshot_no, id)),
""" + items_sql("entl", "entc", ("nc", "nr", "prints", "tableName"), ("columns_",)).replace(" or n.id is not null", "") + f"""
log as (
select project, snapshot_no, case when status in ('added', 'removed') then status else 'modified' end as type, 'endpoint' as category, coalesce(new.name, old.name) as name,
  case when status = 'added' then {PLACE.format('new')} when status = 'removed' then {PLACE.format('old')}
    else coalesce(nullif(concat_ws('; ', case when old.returnType is distinct from new.returnType then 'return type: ' || coalesce(old.returnType, 'undefined') || ' → ' || coalesce(new.returnType, 'undefined') end,
      case when len(coalesce(old.parameters, [])) <> len(coalesce(new.parameters, [])) then 'parameters: ' || len(coalesce(old.parameters, [])) || ' → ' || len(coalesce(new.parameters, [])) end), ''), 'signature changed') end as detail
  from eps where status in ('added', 'removed') or old.handler is distinct from new.handler or old.returnType is distinct from new.returnType or {PRINT.format('old')} <> {PRINT.format('new')}
union all select project, snapshot_no, status, 'entity', id, case when status = 'modified' then coalesce(nullif(concat_ws('; ', case when old.nc <> new.nc then 'columns: ' || old.nc || ' → ' || new.nc end, case when old.nr <> new.nr then 'relations: ' || old.nr || ' → ' || new.nr end), ''), 'schema changed') end from entl where status <> 'unchanged'
union all select project, snapshot_no, status, 'service', id, case when status = 'modified' then coalesce(nullif(concat_ws('; ', case when len(old.methods) <> len(new.methods) then 'methods: ' || len(old.methods) || ' → ' || len(new.methods) end, case when len(old.dependencies) <> len(new.dependencies) then 'dependencies: ' || len(old.dependencies) || ' → ' || len(new.dependencies) end), ''), 'implementation changed') end from svcs where status <> 'unchanged'),
"""
)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _compared(spark, sf_dir)
    return versions.change_log(found["endpoint"], found["entity"], found["service"])


@BOOK.query(LOG + END + "select * from log")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of added, removed and modified endpoints, entities and services."""
    return _log(spark, sf_dir)


LINE = "'- **' || upper(substr(category, 1, 1)) || substr(category, 2) || '**: `' || coalesce(name, 'undefined') || '`' || coalesce(' - ' || nullif(detail, ''), '')"


@BOOK.query(
    LOG + END + f""", ls as (select project, snapshot_no, type, string_agg(line, chr(10) order by line) as body from (select *, {LINE} as line from log) group by all)
select project, snapshot_no, '## [' || snapshot_no || ']' || chr(10) || chr(10) || string_agg('### ' || case type when 'added' then 'Added' when 'modified' then 'Changed' else 'Removed' end || chr(10) || chr(10) || body || chr(10) || chr(10), '' order by case type when 'added' then 1 when 'modified' then 2 else 3 end) as note from ls group by project, snapshot_no"""
)
def release_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown note per project and version."""
    return versions.release_notes(_log(spark, sf_dir))
