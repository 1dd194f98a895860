"""Queries of scalar functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import read
from .base import Book

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle
SNAKE = "regexp_replace(lower(regexp_replace({0}, '([A-Z])', '_\\1', 'g')), '^_', '')"


@BOOK.query(
    f"""select distinct name, lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1-\\2', 'g'), '[\\s_]+', '-', 'g')) as kebab, {SNAKE.format('name')} as snake,
list_aggregate(list_transform(string_split({SNAKE.format('name')}, '_'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), 'string_agg', '') as camel,
case when regexp_matches(lower(name), 'input|request|create|update') then 'input' when regexp_matches(lower(name), 'response|result|output|payload') then 'response' when regexp_matches(lower(name), 'dto') then 'dto' else 'type' end as kind
from (select name from endpoints union select name from type_infos) where name is not null"""
)
def text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of endpoints and types in other cases, and the kind that they speak for."""
    names = read(spark, sf_dir, "endpoints").select("name").union(read(spark, sf_dir, "type_infos").select("name")).where("name is not null").distinct()
    n = F.col("name")
    return names.select("name", T.to_kebab(n).alias("kebab"), T.to_snake(n).alias("snake"), T.snake_to_camel(T.to_snake(n)).alias("camel"), T.kind_of_name(n).alias("kind"))


@BOOK.query(
    """select doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as html, md5(replace(replace(replace(replace(text, '|', '\\|'), '[', '\\['), ']', '\\]'), '`', '\\`')) as markdown,
md5(regexp_replace(text, '[^a-zA-Z0-9_]', '_', 'g')) as id, md5(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))) as plain from documents where text is not null"""
)
def text_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the documents escaped for HTML, Markdown and ids, and without tags."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(T.escape_html(t)).alias("html"), F.md5(T.escape_markdown(t)).alias("markdown"), F.md5(T.sanitize_id(t)).alias("id"), F.md5(T.strip_tags(t)).alias("plain"))


@BOOK.query(
    r"""with f as (select doc_id, regexp_extract(text, '^---\r?\n((?s:.*?))\r?\n---', 1) as block from documents where starts_with(text, '---')),
l as (select doc_id, unnest(string_split_regex(block, '\r?\n')) as line, generate_subscripts(string_split_regex(block, '\r?\n'), 1) as pos from f where block <> '')
select doc_id, trim(string_split(line, ':')[1]) as key, regexp_replace(trim(substr(line, strpos(line, ':') + 1)), '^["'']|["'']$', '', 'g') as value from l where strpos(line, ':') > 1
qualify row_number() over (partition by doc_id, key order by pos desc) = 1"""
)
def text_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of the documents' front matter."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.front_matter(F.col("text")).alias("meta"))
    return docs.select("doc_id", F.explode("meta").alias("key", "value"))


HEADING = r"(?m)^#{1,6} +([^\n]*)"


@BOOK.query(
    """with h as (select doc_id, trim(hs[i], ' ' || chr(13)) as heading, i as pos from (select doc_id, regexp_extract_all(text, '(?m)^#{1,6} +([^\\n]*)', 1) as hs, unnest(range(1, len(regexp_extract_all(text, '(?m)^#{1,6} +([^\\n]*)', 1)) + 1)) as i from documents)),
s as (select doc_id, pos::bigint as pos, heading, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(lower(heading)), '[^a-z0-9_\\s\\-ㄱ-힣]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), ''), 'heading') as slug from h)
select doc_id, pos, heading, case when n = 1 then slug else slug || '-' || (n - 1) end as anchor from (select *, row_number() over (partition by doc_id, slug order by pos) as n from s)"""
)
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the documents with anchors that are unique in each document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(HEADING), 1)).alias("i", "raw"))
    heads = docs.select("doc_id", (F.col("i") + 1).cast("bigint").alias("pos"), F.trim("raw", F.lit(" \r")).alias("heading")).withColumn("slug", T.slug(F.col("heading")))
    n = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("pos"))
    return heads.withColumn("n", n).select("doc_id", "pos", "heading", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), (F.col("n") - 1).cast("string"))).alias("anchor"))


@BOOK.query(
    r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?i)</?(?:iframe|object|embed|form|input|button|link|meta|base)\b[^>]*>', '', 'g'),
'(?i)\s+on\w+\s*=\s*"[^"]*"', '', 'g'), '(?i)\s+on\w+\s*=\s*''[^'']*''', '', 'g'), '(?i)(href|src)\s*=\s*"\s*javascript:[^"]*"', '\1="#"', 'g'), '(?i)(href|src)\s*=\s*''\s*javascript:[^'']*''', '\1=''#''', 'g')) as clean,
md5(regexp_replace(text, '(?s)```mermaid\r?\n(.*?)```', '<div class="mermaid">' || chr(10) || '\1</div>', 'g')) as diagrams from documents where text is not null"""
)
def page_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the documents without dangerous markup, and with fenced diagrams as divisions."""
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(T.sanitize_html(F.col("text"))).alias("clean"), F.md5(T.preserve_mermaid(F.col("text"))).alias("diagrams"))


EXT = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))"
LANG = "case " + " ".join(
    f"when {EXT} in ({', '.join(repr(e) for e in es)}) then '{lang}'"
    for lang, es in (
        ("typescript", ("ts", "tsx")), ("javascript", ("js", "jsx", "mjs", "cjs")), ("python", ("py",)), ("java", ("java",)), ("kotlin", ("kt", "kts")), ("go", ("go",)), ("php", ("php",)), ("c", ("c", "h")), ("cpp", ("cpp", "cc", "cxx", "hpp", "hxx")),
        ("graphql", ("graphql", "gql")), ("yaml", ("yaml", "yml")), ("json", ("json",)), ("vue", ("vue",)), ("svelte", ("svelte",)), ("markdown", ("md",)),
    )
) + " else 'unknown' end"


@BOOK.query(
    f"""select file_id, {LANG} as language, list_aggregate(string_split(path, '/')[-2:], 'string_agg', '/') as short_path, case when len(string_split(path, '/')) >= 2 then string_split(path, '/')[-2] else 'root' end as module,
case when not list_contains(string_split(path, '/'), 'src') then 'other' when list_position(string_split(path, '/'), 'src') + 1 >= len(string_split(path, '/')) then 'root' else string_split(path, '/')[list_position(string_split(path, '/'), 'src') + 1] end as category,
repeat('../', length(regexp_replace(path, '[^/]', '', 'g'))) as prefix from source_files where path is not null"""
)
def scan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, short path, module, category and depth of every file."""
    p = F.col("path")
    return read(spark, sf_dir, "source_files").where("path is not null").select("file_id", T.language_of(p).alias("language"), T.short_path(p).alias("short_path"), T.module_of(p).alias("module"), T.segment_after(p, "src").alias("category"), T.relative_prefix(p).alias("prefix"))


@BOOK.query(
    r"""with q as (select row_id, upper(httpMethod) as method, regexp_replace(path, '[:{](\w+)\}?', '<\1>', 'g') as filled, list_transform(list_filter(coalesce(parameters, []), lambda p: p.location = 'query' and p.name is not null), lambda p: p.name) as qs, auth from endpoints where protocol = 'rest' and path is not null and httpMethod is not null),
u as (select *, filled || case when len(qs) > 0 then '?' || list_aggregate(list_transform(qs, lambda x: x || '=<' || x || '>'), 'string_agg', '&') else '' end as url from q)
select row_id, url, 'curl -X ' || method || ' ''' || url || '''' || case when auth then ' \' || chr(10) || '  -H ''Authorization: Bearer <token>''' else '' end || case when method in ('POST', 'PUT', 'PATCH') then ' \' || chr(10) || '  -H ''Content-Type: application/json''' else '' end as command from u"""
)
def endpoint_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address and command line for every REST endpoint."""
    rows = read(spark, sf_dir, "endpoints").where("protocol = 'rest' and path is not null and httpMethod is not null")
    query = F.transform(F.filter(F.coalesce("parameters", F.array()), lambda p: (p["location"] == "query") & p["name"].isNotNull()), lambda p: p["name"])
    made = rows.select("row_id", F.upper("httpMethod").alias("method"), "auth", T.request_url(F.lit(""), F.col("path"), query).alias("url"))
    return made.select("row_id", "url", T.curl(F.col("method"), F.col("url"), F.coalesce("auth", F.lit(False))).alias("command"))


@BOOK.query(
    r"""select type_id, f.name as field, regexp_extract(f.type, '(?:\w+<)?(\w+)>?', 1) as base, regexp_replace(f.type, '[<>\[\]{}\s]', '_', 'g') as safe, trim(regexp_replace(regexp_replace(regexp_replace(f.type, '\bconst\b', '', 'g'), '[\[\]!*&?]', '', 'g'), '\s+', ' ', 'g')) as clean
from (select type_id, unnest(fields) as f from type_infos)"""
)
def type_fields_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, safe and clean name of every field's type."""
    rows = read(spark, sf_dir, "type_infos").select("type_id", F.explode("fields").alias("f"))
    t = F.col("f.type")
    return rows.select("type_id", F.col("f.name").alias("field"), T.base_type(t).alias("base"), T.sanitize_type(t).alias("safe"), T.clean_type(t).alias("clean"))


@BOOK.query(
    r"""select file_id, length(regexp_replace(regexp_replace(content, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g')) as code_chars, case when length(content) = 0 then '0 Bytes' else
regexp_replace(printf('%.2f', round(length(content) / pow(1024.0, floor(ln(length(content)) / ln(1024.0) + 1e-12)), 2)), '\.?0+$', '') || ' ' || (['Bytes', 'KB', 'MB', 'GB', 'TB', 'PB'])[floor(ln(length(content)) / ln(1024.0) + 1e-12)::int + 1] end as size from source_files where content is not null"""
)
def scan_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters without comments, and the size in words, of every file."""
    n = F.length("content").cast("bigint")
    return read(spark, sf_dir, "source_files").where("content is not null").select("file_id", F.length(T.strip_comments(F.col("content"))).cast("bigint").alias("code_chars"), T.format_bytes(n).alias("size"))
