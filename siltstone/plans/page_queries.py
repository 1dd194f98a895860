"""Queries on pages, memos and what repositories are made with, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detect, memos, pages
from ..tables import read
from .base import Book
from .extract_queries import EXT, text
from .graph_queries import BASE, _flat, last
from .text_queries import LANG

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle

ESC = "replace(replace(replace(replace(coalesce({0}, ''), '|', '\\|'), '[', '\\['), ']', '\\]'), '`', '\\`')"
KEBAB = "lower(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1-\\2', 'g'), '[\\s_]+', '-', 'g'))"
NL = "chr(10)"


@BOOK.query(
    BASE + f""", t as (select project, coalesce(handlerClass, 'misc') as title, coalesce(protocol, '') as a, coalesce(path, fieldName, '') as b, id,
  '## ' || coalesce(name, '') || {NL} || {NL} || case when protocol = 'rest' and httpMethod is not null and path is not null then '`' || httpMethod || '` `' || path || '`' || {NL} || {NL}
  when protocol = 'graphql' and operationType is not null and fieldName is not null then '**GraphQL ' || operationType || '**: `' || fieldName || '`' || {NL} || {NL} else '**Protocol**: ' || coalesce(protocol, '') || {NL} || {NL} end
  || case when auth or deprecated then concat_ws(' · ', case when auth then 'auth required' end, case when deprecated then 'deprecated' end) || {NL} || {NL} else '' end
  || case when len(parameters) > 0 then '| Name | Type | Required | Location |' || {NL} || '|---|---|---|---|' || {NL} || list_aggregate(list_transform(parameters, lambda p: '| ' || {ESC.format('p.name')} || ' | `' || {ESC.format('p.type')} || '` | ' || case when p.required then '✓' else '' end || ' | ' || coalesce(p.location, '-') || ' |' || {NL}), 'string_agg', '') || {NL} else '' end
  || '**Returns**: `' || {ESC.format('returnType')} || '`' || {NL} as body from eps),
l as (select project, title, string_agg(body, {NL} order by a, b, id) as body from t group by all)
select project, 'api/' || {KEBAB.format('title')} || '.md' as path, title, (row_number() over (partition by project order by title) + 9)::int as position, '# ' || title || {NL} || {NL} || body as content from l"""
)
def pages_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each handling class of each project's last version."""
    return pages.endpoint_pages(_flat(last(spark, sf_dir)))


@BOOK.query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def pages_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event per user and type."""
    return pages.first_of(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", "value")


@BOOK.query("select repo, path, arg_max(file_id, (ord, file_id)) as file_id, min(ord) as first_ord from (select *, row_number() over (partition by repo, path order by ord, file_id) as n from source_files) group by all")
def pages_last_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files delivered again the last, at the place of the first."""
    files = read(spark, sf_dir, "source_files").withColumn("at", F.struct("ord", "file_id"))
    return pages.last_of(files, ["repo", "path"], "at", ["file_id"]).select("repo", "path", "file_id", F.col("place.ord").alias("first_ord"))


SECTION = "case when starts_with({0}, 'api/') then 'endpoints' when starts_with({0}, 'entities/') then 'entities' when starts_with({0}, 'architecture') then 'architecture' when starts_with({0}, 'changelog') then 'changelog' when starts_with({0}, 'components/') then 'components' when starts_with({0}, 'hooks/') then 'services' when {0} in ('overview.md', 'index.md') then 'auto' end"
KINDS = "case lower(trim(source)) when 'api_page' then 'api/' when 'changelog' then 'changelog/' when 'adr' then 'architecture/' when 'guide' then 'components/' else 'misc/' end || doc_id || '.md'"


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, title, position) of the documents as pages of a site, by their source."""
    folder = F.lower(F.trim("source"))
    prefix = F.when(folder == "api_page", "api/").when(folder == "changelog", "changelog/").when(folder == "adr", "architecture/").when(folder == "guide", "components/").otherwise("misc/")
    meta = T.front_matter(F.col("text"))
    position = F.try_element_at(meta, F.lit("sidebarPosition")).try_cast("int")
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("repo").alias("project"), F.concat(prefix, F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce(F.try_element_at(meta, F.lit("title")), F.col("path")).alias("title"), position.alias("position"), "doc_id")


META = r"""f as (select doc_id, regexp_extract(text, '^---\r?\n((?s:.*?))\r?\n---', 1) as block from documents where starts_with(text, '---')),
fl as (select doc_id, unnest(string_split_regex(block, '\r?\n')) as line, generate_subscripts(string_split_regex(block, '\r?\n'), 1) as pos from f where block <> ''),
kv as (select doc_id, trim(string_split(line, ':')[1]) as key, regexp_replace(trim(substr(line, strpos(line, ':') + 1)), '^["'']|["'']$', '', 'g') as value from fl where strpos(line, ':') > 1 qualify row_number() over (partition by doc_id, key order by pos desc) = 1)"""


@BOOK.query(
    f"with {META}, p as (select d.repo as project, {KINDS.replace('source', 'd.source').replace('doc_id', 'd.doc_id')} as path, coalesce(t.value, d.path) as title, try_cast(s.value as int) as position from documents d left join kv t on t.doc_id = d.doc_id and t.key = 'title' left join kv s on s.doc_id = d.doc_id and s.key = 'sidebarPosition'),\n"
    + f"k as (select *, {SECTION.format('path')} as section, coalesce(nullif(position, 0), 999) as place from p), c as (select *, count(*) over (partition by project, section) as n from k where section is not null)\n"
    + "select project, section, case when n = 1 then 'doc' else 'category' end as kind, (row_number() over (partition by project, section order by place, path))::int as rank, path, title, case when n = 1 then place else case section when 'endpoints' then 10 when 'entities' then 100 when 'architecture' then 1000 when 'changelog' then 9999 else 999 end end as section_position from c"
)
def pages_sidebar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as pages of a sidebar, by section and position."""
    return pages.sidebar(_site(spark, sf_dir).drop("doc_id"))


@BOOK.query(
    f"with {META} select d.doc_id, '---' || {NL} || 'title: \"' || replace(coalesce(t.value, d.path, ''), '\"', '\\\"') || '\"' || {NL} || coalesce('description: \"' || replace(d.lang, '\"', '\\\"') || '\"' || {NL}, '') || case when d.repo is not null then 'tags: [\"' || d.repo || '\"]' || {NL} else '' end || coalesce('sidebar_position: ' || try_cast(s.value as int) || {NL}, '') || 'page_id: \"' || {KINDS.replace('source', 'd.source').replace('doc_id', 'd.doc_id').replace(chr(39) + '.md' + chr(39), chr(39) + chr(39))} || '\"' || {NL} || '---' || {NL} as block from documents d left join kv t on t.doc_id = d.doc_id and t.key = 'title' left join kv s on s.doc_id = d.doc_id and s.key = 'sidebarPosition'"
)
def pages_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of settings of every document as a page."""
    site = _site(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    tags = F.when(F.col("project").isNotNull(), F.array("project")).otherwise(F.array().cast("array<string>"))
    return site.select("doc_id", pages.front_matter(F.col("title"), F.col("lang"), tags, F.col("position"), F.col("path")).alias("block"))


LINK = "regexp_extract_all(text, '\\]\\(([^)\\s]+)\\)', 1)"


@BOOK.query(
    f"""with l as (select doc_id, regexp_replace(x, '[?#].*$', '') as link from (select doc_id, unnest({LINK}) as x from documents) where not regexp_matches(x, '^(?:[a-z][a-z0-9+.-]*:|#|//)')),
w as (select doc_id, link, regexp_replace(regexp_replace(link, '^(?:\\./|\\.\\./|/)+', ''), '(?:\\.md|\\.html|/)$', '') as want from l where link <> ''),
k as (select distinct regexp_replace(path, '\\.md$', '') as slug from documents where path is not null)
select doc_id, link, coalesce((select k.slug from k where k.slug = w.want), (select k.slug from k where k.slug = w.want || '/index'), (select min(k.slug) from k where starts_with(k.slug, w.want || '/')), 'index') as target from w"""
)
def pages_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the relative links of the documents lead."""
    docs = read(spark, sf_dir, "documents")
    slugs = docs.where("path is not null").select(F.regexp_replace("path", r"\.md$", "").alias("slug"))
    return pages.resolved(pages.links(docs), slugs)


def _stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two stores of memos: what was written before the middle of the year, and what arrived from then on."""
    docs = read(spark, sf_dir, "documents").where("lower(trim(source)) = 'memo' and text is not null")
    memo = lambda df: df.select(F.col("repo").alias("page_id"), F.substring(F.md5("path"), 1, 12).alias("memo_id"), F.md5("text").alias("text"), "created_at")
    return memo(docs.where("created_at < timestamp'2024-07-01'")), memo(docs.where("ingested_at >= timestamp'2024-07-01'"))


STORES = """with m as (select repo as page_id, substr(md5(path), 1, 12) as memo_id, md5(text) as text, created_at, ingested_at from documents where lower(trim(source)) = 'memo' and text is not null),
a as (select page_id, memo_id, text, created_at from m where created_at < timestamp '2024-07-01'), b as (select page_id, memo_id, text, created_at from m where ingested_at >= timestamp '2024-07-01')
"""


@BOOK.query(STORES + ", u as (select *, 0 as rk from a union all select *, 1 from b), h as (select * from u where page_id is not null and memo_id is not null qualify row_number() over (partition by page_id, memo_id order by rk desc, created_at desc nulls last, text desc) = 1) select page_id, memo_id, text, created_at, (row_number() over (partition by page_id order by created_at nulls first, memo_id))::int as position from h")
def memo_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores of memos as one."""
    return memos.merge(*_stores(spark, sf_dir))


@BOOK.query(STORES + "select *, false as personal from a where not exists (select 1 from b where b.page_id = a.page_id and b.memo_id = a.memo_id) union all select *, true from b")
def memo_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared memos that no personal one hides, and the personal ones."""
    return memos.displayed(*_stores(spark, sf_dir))


@BOOK.query(STORES + "select memo_id, page_id, text, created_at from b where memo_id not in (select memo_id from a where memo_id is not null)")
def memo_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memos that the first store doesn't have."""
    return memos.imported(*_stores(spark, sf_dir))


@BOOK.query(f"select repo, language, files, cast(round(100.0 * files / sum(files) over (partition by repo)) as bigint) as percent from (select repo, {LANG} as language, count(*) as files from source_files where path is not null and not regexp_matches(path, '(?:^|/)(?:node_modules|dist|build|\\.git)/') group by all) where language <> 'unknown'")
def detect_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each language in each repository."""
    return detect.languages(read(spark, sf_dir, "source_files"))


def _frameworks_sql() -> str:
    one = lambda n, e, p: f"select repo, path, ord, file_id, {text(n)} as framework from source_files where path is not null and {EXT} = {text(e)} and regexp_matches(content, {text(p)})"
    return "select repo, framework, count(*) as files, arg_min(path, (ord, file_id)) as first_file from (select distinct * from (" + " union all ".join(one(*r) for r in detect.FRAMEWORKS) + ")) group by all"


@BOOK.query(_frameworks_sql())
def detect_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frameworks that the files of each repository speak for."""
    return detect.frameworks(read(spark, sf_dir, "source_files"))


def _parsers_sql() -> str:
    case = lambda v: "case " + " ".join(f"when {EXT} in ({', '.join(text(e) for e in exts)}) then {v(i, name)}" for i, (name, exts) in enumerate(detect.PARSERS)) + " end"
    return f"select repo, parser, files, (row_number() over (partition by repo order by files desc, i))::int as rank from (select repo, {case(lambda i, n: text(n))} as parser, {case(lambda i, n: str(i))} as i, count(*) as files from source_files where not regexp_matches(path, '(?:^|/)(?:node_modules|dist|build|\\.git)/') group by all) where parser is not null"


@BOOK.query(_parsers_sql())
def detect_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractors that fit each repository, by the number of files."""
    return detect.parsers(read(spark, sf_dir, "source_files"))
