"""More pages, diagrams and reports of each project's last version, and caches of what was read, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import collections, graph, pages, search, versions
from ..tables import read
from .base import Book
from .graph_queries import BASE, CODE, SAFE, TOP, _flat, last
from .page_queries import ESC, KEBAB, META, NL
from .search_queries import LEXICAL, titled
from .version_queries import BASE as VERSIONS
from .version_queries import END, ENDPOINTS, _compared

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle

OWNER = "coalesce(handlerClass, 'undefined')"


@BOOK.query(
    BASE + ", " + TOP.format("n", "eps", "id", 10) + f""", m as (select *, {SAFE.format(OWNER)} as h, {SAFE.format('serviceRef')} as s, coalesce(httpMethod, operationType, 'CALL') as method, coalesce(path, fieldName, name, 'undefined') as place from n),
ls as (select distinct project, 0 as part, '' as a, '' as b, '    participant Client' as line, 0 as edge from m
union all select distinct project, 0, '1', x, '    participant ' || x, 0 from (select project, h as x from m union select project, s from m where serviceRef is not null)
union all select project, 1, id, '0', '    Client->>+' || h || ': ' || method || ' ' || place, 1 from m
union all select project, 1, id, '1', '    ' || h || '->>+' || s || ': ' || coalesce(handler, 'undefined') || '()', 1 from m where serviceRef is not null
union all select project, 1, id, '2', '    ' || s || '-->>-' || h || ': ' || coalesce(returnType, 'undefined'), 1 from m where serviceRef is not null
union all select project, 1, id, '3', '    ' || h || '-->>-Client: ' || case when httpMethod is not null then '200 OK' else coalesce(returnType, 'undefined') end, 1 from m) """
    + CODE.format("sequenceDiagram")
)
def diagram_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence diagram of each project's first endpoints."""
    return graph.sequence_diagram(_flat(last(spark, sf_dir)))


@BOOK.query(
    BASE + f""", c as (select project, {OWNER} as name, count(*) filter (protocol = 'rest') as rest, count(*) filter (protocol = 'graphql') as gql from held group by all), {TOP.format('sv', 'svc', 'name', 15)}, {TOP.format('en', 'ent', 'name', 10)}, p as (select distinct project from held),
ls as (select project, 0 as part, '0' as a, '' as b, '    subgraph Client["Client Layer"]' as line, 0 as edge from p union all select project, 0, '1', 'CLIENT', '        CLIENT["Client / Browser"]', 0 from p union all select project, 0, '2', '', '    end', 0 from p
union all select distinct project, 1, '0', '', '    subgraph API["API Layer"]', 0 from c union all select distinct project, 1, '2', '', '    end', 0 from c
union all select project, 1, '1', name, '        ' || {SAFE.format('name')} || '["' || name || case when rest > 0 then '<br/>' || rest || ' REST' else '' end || case when gql > 0 then '<br/>' || gql || ' GraphQL' else '' end || '"]', 0 from c
union all select distinct project, 2, '0', '', '    subgraph Services["Service Layer"]', 0 from sv union all select distinct project, 2, '2', '', '    end', 0 from sv
union all select project, 2, '1', name, '        ' || {SAFE.format('name')} || '["' || name || '<br/>' || len(methods) || ' methods"]', 0 from sv
union all select distinct project, 3, '0', '', '    subgraph Data["Data Layer"]', 0 from en union all select distinct project, 3, '2', '', '    end', 0 from en
union all select project, 3, '1', name, '        ' || {SAFE.format('name')} || '[("' || name || '<br/>' || lower(name) || 's")]', 0 from en
union all select project, 4, name, '', '    CLIENT --> ' || {SAFE.format('name')}, 1 from c
union all select distinct project, 5, {SAFE.format(OWNER)}, {SAFE.format('serviceRef')}, '    ' || {SAFE.format(OWNER)} || ' --> ' || {SAFE.format('serviceRef')}, 1 from held where serviceRef is not null
union all select project, 6, {SAFE.format('source')}, {SAFE.format('target')}, '    ' || {SAFE.format('source')} || ' --> ' || {SAFE.format('target')}, 1 from dep where exists (select 1 from ent e where e.project = dep.project and e.name = dep.target)) """
    + CODE.format("flowchart TB")
)
def diagram_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of each project."""
    held = last(spark, sf_dir)
    return graph.architecture_diagram(_flat(held), collections.services(held), collections.entities(held))


MODULE = "case when len(string_split(p, '/')) >= 2 then string_split(p, '/')[-2] else 'root' end"


@BOOK.query(
    BASE + f""", {TOP.format('e', 'dep', 'source, target', 80)}, sp as (select project, handlerClass as node, min(filePath) as p from held where handlerClass is not null and filePath is not null group by all),
n as (select x.project, x.node, coalesce({MODULE.replace('(p,', '(sp.p,')}, 'other') as module from (select project, source as node from e union select project, target from e) x left join sp using (project, node)),
nn as (select project, node, case when exists (select 1 from sp where sp.project = n.project and sp.node = n.node) then module else 'other' end as module from n), g as (select distinct project, module from nn),
ls as (select project, 0 as part, module as a, '0' as b, '    subgraph ' || {SAFE.format('module')} || '["' || module || '"]' as line, 0 as edge from g union all select project, 0, module, '2', '    end', 0 from g
union all select project, 0, module, '1' || node, '        ' || {SAFE.format('node')} || '["' || node || '"]', 0 from nn
union all select project, 1, source, target, '    ' || {SAFE.format('source')} || ' -.-> ' || {SAFE.format('target')}, 1 from e) """
    + CODE.format("flowchart LR")
)
def diagram_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependencies of each project's services by module."""
    held = last(spark, sf_dir)
    files = _flat(held).where("handlerClass is not null and filePath is not null").groupBy("project", F.col("handlerClass").alias("node")).agg(T.module_of(F.min("filePath")).alias("module"))
    return graph.dependency_diagram(graph.service_edges(collections.services(held)), files)


@BOOK.query(
    BASE + """, g as (select project, upper(substr(s, 1, 1)) || substr(s, 2) as domain, count(*) as endpoints from (select project, coalesce(list_filter(string_split(coalesce(path, fieldName, ''), '/'), lambda x: length(x) > 0)[1], 'Other') as s from held) group by all),
m as (select e.project, e.name, min(g.domain) as domain from ent e join g on e.project = g.project and (contains(lower(e.name), lower(g.domain)) or contains(lower(g.domain), lower(e.name))) group by all),
p as (select project, domain, count(*) as entities from (select e.project, coalesce(m.domain, upper(substr(e.name, 1, 1)) || substr(e.name, 2)) as domain from ent e left join m using (project, name)) group by all),
b as (select project, domain, coalesce(endpoints, 0) as endpoints, coalesce(entities, 0) as entities from g full join p using (project, domain))
select project, case when endpoints + entities >= 2 then domain else 'Other' end as domain, sum(endpoints)::bigint as endpoints, sum(entities)::bigint as entities from b group by all"""
)
def group_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints and entities of each project by domain."""
    held = last(spark, sf_dir)
    return graph.domains(_flat(held), collections.entities(held))


def _list_sql(title: str, c: str) -> str:
    return f"case when len({c}) > 0 then '## {title}' || {NL} || {NL} || list_aggregate(list_transform({c}, lambda x: '- `' || x || '`'), 'string_agg', {NL}) || {NL} || {NL} else '' end"


@BOOK.query(
    BASE + f""", u as (select project, target as name, list_sort(list(distinct source)) as users from dep group by all)
select project, 'hooks/' || {KEBAB.format('name')} || '.md' as path, name as title, (row_number() over (partition by project order by name) + 299)::int as position, '# ' || name || {NL} || {NL} || {_list_sql('Methods', 'methods')} || {_list_sql('Dependencies', 'coalesce(deps, [])')} || {_list_sql('Used by', 'coalesce(users, [])')} as content from svc left join u using (project, name)"""
)
def pages_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each service."""
    services = collections.services(last(spark, sf_dir))
    return pages.service_pages(services, graph.service_edges(services))


@BOOK.query(
    BASE + f""", tc as (select project, name, string_agg('| ' || {ESC.format('col')} || ' | `' || {ESC.format('type')} || '` | ' || case when nullable then '✓' else '' end || ' |' || {NL}, '' order by col) as t from (select project, name, p.name as col, min(p.type) as type, not bool_or(coalesce(p.required, false)) as nullable from (select project, name, unnest(parameters) as p from ent_rows) where p.name is not null group by all) group by all),
tr as (select project, name, string_agg('| ' || {ESC.format('type')} || ' | `' || {ESC.format('target')} || '` |' || {NL}, '' order by target, type) as t from rels group by all)
select project, 'entities/' || {KEBAB.format('name')} || '.md' as path, name as title, (row_number() over (partition by project order by name) + 99)::int as position, '# ' || name || {NL} || {NL} || 'Table: `' || lower(name) || 's`' || {NL} || {NL}
  || coalesce('| Column | Type | Nullable |' || {NL} || '|---|---|---|' || {NL} || tc.t, '') || coalesce({NL} || '| Relation | Target |' || {NL} || '|---|---|' || {NL} || tr.t, '') as content from ent left join tc using (project, name) left join tr using (project, name)"""
)
def pages_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each entity."""
    return pages.entity_pages(collections.entities(last(spark, sf_dir)))


HTML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@BOOK.query(
    f"with {META} select d.doc_id, '<title>' || {HTML.format('x.title')} || '</title>' || coalesce({NL} || '    <meta name=\"description\" content=\"' || {HTML.format('x.descr')} || '\" />', '') || {NL} || '    <meta property=\"og:title\" content=\"' || {HTML.format('x.title')} || '\" />' || coalesce({NL} || '    <meta property=\"og:description\" content=\"' || {HTML.format('x.descr')} || '\" />', '') || {NL} || '    <meta property=\"og:type\" content=\"article\" />' as tags "
    "from documents d join (select d.doc_id, coalesce(t.value, d.path, '') as title, s.value as descr from documents d left join kv t on t.doc_id = d.doc_id and t.key = 'title' left join (select doc_id, nullif(value, '') as value from kv where key = 'description') s on s.doc_id = d.doc_id) x on x.doc_id = d.doc_id"
)
def pages_head_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of every document as a page."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "path", T.front_matter(F.col("text")).alias("meta"))
    title = F.coalesce(F.try_element_at("meta", F.lit("title")), "path", F.lit(""))
    return docs.select("doc_id", pages.head_tags(title, F.col("meta")).alias("tags"))


ICON = {"added": "+", "removed": "-", "modified": "~"}


@BOOK.query(
    VERSIONS + ENDPOINTS + END + f""", pl as (select project, snapshot_no, id, string_agg('  - ' || case status when 'added' then '+' when 'removed' then '-' else '~' end || ' `' || coalesce(name, 'undefined') || '`: ' || coalesce(prev_type, 'n/a') || ' → ' || coalesce(curr_type, 'n/a'), {NL} order by name) as body from params where status <> 'unchanged' group by all),
e as (select eps.project, eps.snapshot_no, eps.id, '### ' || case status when 'added' then '+' when 'removed' then '-' else '~' end || ' ' || coalesce(new.httpMethod, old.httpMethod, '') || ' ' || coalesce(new.path, old.path, new.name, old.name, '') || {NL}
  || case when status = 'modified' and new.returnType is distinct from old.returnType then {NL} || '- Return type: `' || coalesce(old.returnType, 'undefined') || '` → `' || coalesce(new.returnType, 'undefined') || '`' else '' end || case when status = 'modified' and new.auth is distinct from old.auth then {NL} || '- Auth requirement changed' else '' end
  || coalesce({NL} || '- Parameters:' || {NL} || pl.body, '') as part, status from eps left join pl using (project, snapshot_no, id) where status <> 'unchanged')
select project, snapshot_no, '# API Changes: ' || snapshot_no || {NL} || {NL} || '| Added | Removed | Modified |' || {NL} || '|---|---|---|' || {NL} || '| ' || count(*) filter (status = 'added') || ' | ' || count(*) filter (status = 'removed') || ' | ' || count(*) filter (status = 'modified') || ' |' || {NL} || {NL} || string_agg(part, {NL} || {NL} order by id) as report from e group by project, snapshot_no"""
)
def version_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown report of the changed endpoints of every version."""
    return versions.report(_compared(spark, sf_dir)["endpoint"])


@BOOK.query("select distinct c.repo as project, c.name as component, coalesce((select p.name from type_infos p where p.repo = c.repo and p.name = c.name || 'Props' limit 1), (select p.name from type_infos p where p.repo = c.repo and p.name = c.name || 'Property' limit 1)) as props from type_infos c where c.name is not null and exists (select 1 from type_infos p where p.repo = c.repo and p.name in (c.name || 'Props', c.name || 'Property'))")
def graph_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with the type of their properties."""
    return graph.props_of(read(spark, sf_dir, "type_infos").withColumnRenamed("repo", "project"))


PRINT = "bit_xor(('0x' || substr(md5(coalesce(path, '') || ':' || md5(coalesce(content, ''))), 1, 15))::bigint)"


@BOOK.query(
    f"""with v as (select repo, path, content, file_id, min(file_id) over (partition by repo, path) as first, max(file_id) over (partition by repo, path) as last from source_files)
select repo, count(*) as files, printf('%.2f', round(sum(length(content)) / 1024.0::double, 2)) as kb, {PRINT} filter (file_id = first) = {PRINT} filter (file_id = last) as hit from v where path is not null group by repo"""
)
def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of what each repository delivered, and whether its first and last deliveries have one fingerprint."""
    by = Window.partitionBy("repo", "path")
    mark = F.conv(F.substring(F.md5(F.concat(F.coalesce("path", F.lit("")), F.lit(":"), F.md5(F.coalesce("content", F.lit(""))))), 1, 15), 16, 10).cast("bigint")
    rows = read(spark, sf_dir, "source_files").where("path is not null").select("repo", "path", "file_id", F.length("content").alias("n"), mark.alias("mark"))
    rows = rows.withColumns({"first": F.min("file_id").over(by), "last": F.max("file_id").over(by)})
    prints = rows.groupBy("repo").agg(F.count("*").alias("files"), F.sum("n").alias("n"), F.bit_xor(F.when(F.col("file_id") == F.col("first"), F.col("mark"))).alias("a"), F.bit_xor(F.when(F.col("file_id") == F.col("last"), F.col("mark"))).alias("b"))
    return prints.select("repo", "files", F.format_string("%.2f", F.round(F.col("n") / 1024.0, 2)).alias("kb"), (F.col("a") == F.col("b")).alias("hit"))


@BOOK.query(
    """with e as (select repo, string_split(min(path), '/') as a, string_split(max(path), '/') as b from source_files where path is not null group by repo),
n as (select repo, a, list_max(list_filter(range(0, greatest(least(len(a), len(b)), 1)), lambda n: n < least(len(a), len(b)) and a[1:n] = b[1:n])) as n from e)
select repo, coalesce(list_aggregate(a[1:n], 'string_agg', '/'), '') as folder from n"""
)
def arch_common_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder that all files of a repository share."""
    return graph.common_folder(read(spark, sf_dir, "source_files"))


@BOOK.query(
    BASE + """select project, count(*) > 0 as endpoints, bool_or(serviceRef is not null) as entities, bool_or(handlerClass is not null) as services, bool_or(coalesce(auth, false)) as auth, project in (select repo from type_infos where repo is not null) as components,
project in (select project from change_entries where project is not null) as changelog from held group by project"""
)
def arch_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sections a project's site has, by what there is."""
    flat = _flat(last(spark, sf_dir))
    some = lambda c: F.max(F.col(c).isNotNull())
    counts = flat.groupBy("project").agg((F.count("*") > 0).alias("endpoints"), some("serviceRef").alias("entities"), some("handlerClass").alias("services"), F.max(F.coalesce("auth", F.lit(False))).alias("auth"))
    known = lambda table, c, name: read(spark, sf_dir, table).where(f"{c} is not null").select(F.col(c).alias("project"), F.lit(True).alias(name)).distinct()
    out = counts.join(known("type_infos", "repo", "components"), "project", "left").join(known("change_entries", "project", "changelog"), "project", "left")
    return out.fillna(False, ["components", "changelog"])


@BOOK.query("select repo, bool_or(name like '%Context') as context, bool_or(name like '%Store' or name like '%State') as store, bool_or(regexp_matches(name, '^use[A-Z]')) as hooks from type_infos where name is not null group by repo")
def arch_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a repository keeps state, by the names of its types."""
    name = F.col("name")
    types = read(spark, sf_dir, "type_infos").where("name is not null")
    return types.groupBy("repo").agg(F.max(name.endswith("Context")).alias("context"), F.max(name.endswith("Store") | name.endswith("State")).alias("store"), F.max(name.rlike("^use[A-Z]")).alias("hooks"))


@BOOK.query(
    """with f as (select repo, name, type_id, x.name as field, x.type as type, i from (select repo, name, type_id, unnest(fields) as x, generate_subscripts(fields, 1) as i from type_infos where name is not null) where x.name is not null),
m as (select repo, name, field, type, type_id, i from f qualify row_number() over (partition by repo, name, field order by type_id, i) = 1)
select repo, name, field, type, (row_number() over (partition by repo, name order by type_id, i))::int as place from m"""
)
def type_fields_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of types of one name as one type."""
    return graph.merged_fields(read(spark, sf_dir, "type_infos"))


@BOOK.query(
    LEXICAL + """, h as (select query, doc_id, round(0.7 * coalesce(lexical, 0) + 0.3 * coalesce(boost, 0), 6) as score from boost full join lex using (query, doc_id)),
b as (select query, doc_id, score from h where score >= 0.1 qualify row_number() over (partition by query order by score desc, doc_id) <= 10)
select query, doc_id, round(1 - (row_number() over (partition by query order by score desc, doc_id) - 1) / (count(*) over (partition by query))::double, 6) as score from b"""
)
def search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each query with a score by rank."""
    docs = titled(spark, sf_dir)
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.col("title").alias("text"))
    return search.reranked(search.hybrid(docs, asked))
