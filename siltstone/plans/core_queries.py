"""Queries on the corpus and the relational tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import read
from .base import Book

BOOK = Book()
QUERIES, ORACLE, query = BOOK.queries, BOOK.oracle, BOOK.query


@query("select coalesce(lang, 'unknown') as language, count(*) as files, cast(round(100.0 * count(*) / sum(count(*)) over ()) as bigint) as percent from documents group by 1")
def scan_language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each language label."""
    counts = read(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"))
    # At most as many rows as there are labels.
    return counts.withColumn("percent", F.round(100.0 * F.col("files") / F.sum("files").over(Window.partitionBy())).cast("bigint"))


@query("select lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as extension, count(*) as files, sum(length(content)) ::bigint as chars from source_files where path not like '%/dist/%' and path not like '%node_modules/%' group by 1")
def scan_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and characters by extension, built folders left out."""
    files = read(spark, sf_dir, "source_files").where("path not like '%/dist/%' and path not like '%node_modules/%'")
    return files.groupBy(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension")).agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


@query(
    """select upper(coalesce(protocol, 'other')) as protocol, coalesce(handlerClass, 'misc') as handler_class, count(*) as endpoints, count(*) filter (where deprecated) as deprecated_endpoints
from endpoints group by all"""
)
def endpoint_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints by protocol and handler class."""
    rows = read(spark, sf_dir, "endpoints")
    return rows.groupBy(F.upper(F.coalesce("protocol", F.lit("other"))).alias("protocol"), F.coalesce("handlerClass", F.lit("misc")).alias("handler_class")).agg(F.count("*").alias("endpoints"), F.count_if("deprecated").alias("deprecated_endpoints"))


@query("select project, upper(coalesce(httpMethod, operationType, 'OTHER')) as method, count(*) as endpoints from endpoints group by all")
def endpoint_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints by project and HTTP method or operation."""
    return read(spark, sf_dir, "endpoints").groupBy("project", F.upper(F.coalesce("httpMethod", "operationType", F.lit("OTHER"))).alias("method")).agg(F.count("*").alias("endpoints"))


@query("select row_id, p.name as name, p.type as type, coalesce(p.required, false) as required from (select row_id, unnest(parameters) as p from endpoints)")
def endpoint_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of all endpoints, one to a row."""
    rows = read(spark, sf_dir, "endpoints").select("row_id", F.explode("parameters").alias("p"))
    return rows.select("row_id", "p.name", "p.type", F.coalesce("p.required", F.lit(False)).alias("required"))


@query("select row_id, unnest(regexp_extract_all(path, '\\{(\\w+)\\}', 1)) as param from endpoints where path is not null")
def extract_path_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters in the paths of endpoints."""
    return read(spark, sf_dir, "endpoints").where("path is not null").select("row_id", F.explode(F.regexp_extract_all("path", F.lit(r"\{(\w+)\}"), 1)).alias("param"))


@query(
    """with g as (select upper(substr(s, 1, 1)) || substr(s, 2) as name, n from (select string_split(ltrim(trim(path), '/'), '/')[1] as s, count(*) as n from endpoints where path is not null group by 1))
select case when n >= 20 and name <> '' then name else 'Other' end as name, sum(n)::bigint as members from g group by 1"""
)
def group_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints by the first part of the path; groups of fewer than twenty fold into one."""
    part = F.substring_index(F.ltrim(F.trim("path"), F.lit("/")), "/", 1)
    counts = read(spark, sf_dir, "endpoints").where("path is not null").select(part.alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    named = counts.withColumn("name", F.concat(F.upper(F.substring("s", 1, 1)), F.expr("substr(s, 2)")))
    return named.groupBy(F.when((F.col("n") >= 20) & (F.col("name") != ""), F.col("name")).otherwise("Other").alias("name")).agg(F.sum("n").alias("members"))


@query("select distinct e.project, e.path from endpoints e anti join source_files f on e.project = f.repo and e.filePath = f.path where e.path is not null and e.filePath is not null")
def group_ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints whose file is not among the source files."""
    endpoints = read(spark, sf_dir, "endpoints").where("path is not null and filePath is not null").select("project", "path", "filePath")
    files = read(spark, sf_dir, "source_files").select(F.col("repo").alias("project"), F.col("path").alias("filePath"))
    return endpoints.join(files, ["project", "filePath"], "left_anti").select("project", "path").distinct()


@query("select l_suppkey, count(distinct l_partkey) as parts from lineitem group by 1 order by parts desc, l_suppkey limit 15")
def graph_top_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen suppliers with the most parts."""
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts")).orderBy(F.desc("parts"), "l_suppkey").limit(15)


@query("select r_name, n_name, count(c_custkey) as customers from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey group by all")
def graph_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of three steps: region, nation, customers."""
    nations = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    counts = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return nations.join(counts, F.col("n_nationkey") == F.col("c_nationkey")).select("r_name", "n_name", "customers")


PREV, CURR = "c_custkey % 10 <> 0", "c_custkey % 10 <> 1"


@query(
    """with p as (select c_custkey, c_mktsegment from customer where c_custkey % 10 <> 0),
c as (select c_custkey, case when c_custkey % 7 = 0 then 'CHANGED' else c_mktsegment end as c_mktsegment from customer where c_custkey % 10 <> 1)
select c_custkey, case when p.c_mktsegment is null then 'added' when c.c_mktsegment is null then 'removed' when p.c_mktsegment <> c.c_mktsegment then 'modified' else 'unchanged' end as status
from p full join c using (c_custkey)"""
)
def diff_version_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table, record by record, unchanged ones included."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    curr = rows.where(CURR).select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("now"))
    status = F.when(F.col("c_mktsegment").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("c_mktsegment") != F.col("now"), "modified").otherwise("unchanged")
    return rows.where(PREV).join(curr, "c_custkey", "full_outer").select("c_custkey", status.alias("status"))


@query("select project, lower(trim(type)) as type, count(*) as entries, count(distinct name) as names from change_entries group by all")
def change_log_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change entries by project and type."""
    return read(spark, sf_dir, "change_entries").groupBy("project", F.lower(F.trim("type")).alias("type")).agg(F.count("*").alias("entries"), F.countDistinct("name").alias("names"))


@query("select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by all")
def pages_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event per user and type."""
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query(
    """select user_id, count(*) as sessions, max(n) as longest from (
  select user_id, s, count(*) as n from (select user_id, sum(b) over (partition by user_id order by ts, event_id) as s from
    (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hours then 0 else 1 end as b from events)) group by all) group by 1"""
)
def watch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events with less than six hours between them."""
    sessions = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("select event_id, (props ->> '$.k')::bigint as k from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of the JSON properties of events."""
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(
    """select coalesce(lower(trim(source)), '') as source, count(*) as documents, bit_xor(('0x' || substr(md5(doc_id || ':' || md5(coalesce(text, ''))), 1, 15))::bigint) as fingerprint from documents group by 1"""
)
def cache_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of the inputs of each source, in any order: the rows' hashes combine before the shuffle, no group is gathered."""
    mark = F.conv(F.substring(F.md5(F.concat("doc_id", F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))), 1, 15), 16, 10).cast("bigint")
    docs = read(spark, sf_dir, "documents").select(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), mark.alias("mark"))
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.bit_xor("mark").alias("fingerprint"))


@query("select type_id, f.name as field, f.type as type from (select type_id, unnest(fields) as f from type_infos where name not like '%Input' and name not like '%Request') where coalesce(f.required, false)")
def type_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields of the types that are no inputs."""
    types = read(spark, sf_dir, "type_infos").where("name not like '%Input' and name not like '%Request'").select("type_id", F.explode("fields").alias("f"))
    return types.where(F.coalesce("f.required", F.lit(False))).select("type_id", F.col("f.name").alias("field"), F.col("f.type").alias("type"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(avg(l_discount), 6) as discount, count(*) as lines from lineitem group by all")
def line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by flag and status."""
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("lines"))


@query("select doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) as plain from documents where text is not null")
def page_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without tags, blanks collapsed."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", "<[^>]*>", ""), r"[ \t\r\n\f\x0b]+", " "))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", plain.alias("plain"))


@query("select file_id, unnest(regexp_extract_all(content, '(?m)^import [^\\n]*?from [\"'']([^\"''\\n]+)[\"'']', 1)) as module from source_files where content is not null")
def extract_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that script files import."""
    found = F.regexp_extract_all("content", F.lit("(?m)^import [^\\n]*?from [\"']([^\"'\\n]+)[\"']"), 1)
    return read(spark, sf_dir, "source_files").where("content is not null").select("file_id", F.explode(found).alias("module"))


@query("select file_id, unnest(regexp_extract_all(content, '(?m)^class (\\w+)', 1)) as name from source_files where path like '%.py'")
def extract_python_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes at the top of Python files."""
    return read(spark, sf_dir, "source_files").where("path like '%.py'").select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^class (\w+)"), 1)).alias("name"))


@query("select file_id, unnest(regexp_extract_all(content, '(?m)^[ \\t]*@(?:Get|Post|Put|Patch|Delete)(?:Mapping)?\\(\\s*[\"'']([^\"''\\n]*)[\"'']', 1)) as route from source_files where content is not null")
def extract_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that annotations on controllers name."""
    found = F.regexp_extract_all("content", F.lit("(?m)^[ \\t]*@(?:Get|Post|Put|Patch|Delete)(?:Mapping)?\\(\\s*[\"']([^\"'\\n]*)[\"']"), 1)
    return read(spark, sf_dir, "source_files").where("content is not null").select("file_id", F.explode(found).alias("route"))
