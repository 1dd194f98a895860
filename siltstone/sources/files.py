"""Source trees, pages and analysis results as tables, and back.

A missing folder is an error of Spark; unreadable JSON gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.detect import IGNORED

#: Files that are read without stated patterns. Fixed values.
DEFAULT_PATTERNS = ("*.ts", "*.tsx", "*.js", "*.jsx", "*.py", "*.java", "*.kt", "*.go", "*.graphql")


def glob_like(path: Column, glob: str) -> Column:
    """Whether a path, or its last part, fits a pattern with ``*``, ``**``, ``?`` and ``{a,b}``."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c, "\\" + c if c in ".+()[]^$|\\" else c)
        i += 1
    return path.rlike(f"^(?:.*/)?{out}$" if "/" not in glob else f"^{out}$")


def routed(files: DataFrame, routes: dict[str, str]) -> DataFrame:
    """``files`` with ``parser``: a row for each parser one of whose patterns (separated by blanks) the path fits."""
    fits = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [glob_like(F.col("path"), g) for g in globs.split()]), F.lit(name)) for name, globs in routes.items()]))
    return files.where("path is not null").withColumn("parser", F.explode(fits))


def read_files(spark: SparkSession, folder: str, patterns: tuple[str, ...] = DEFAULT_PATTERNS) -> DataFrame:
    """(path, content, language): every file below ``folder`` that fits a pattern, once; ignored folders left out. A file is one row."""
    names = ",".join(patterns)
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + names + "}").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), F.col("value").alias("content"), T.language_of(path).alias("language")).where(~F.col("path").rlike(IGNORED))


def read_pages(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, title, meta, body) of the Markdown files of a folder; the title is that of the front matter, else the first heading, else the file's name."""
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    meta = T.front_matter(F.col("raw"))
    heading = F.nullif(F.trim(F.regexp_extract("raw", r"(?m)^# ([^\n]*)", 1)), F.lit(""))
    name = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    return rows.select("path", F.coalesce(F.try_element_at(meta, F.lit("title")), heading, name).alias("title"), meta.alias("meta"), T.body_of(F.col("raw")).alias("body"))


ENDPOINT = "struct<protocol:string,httpMethod:string,path:string,operationType:string,fieldName:string,name:string,handler:string,handlerClass:string,parameters:array<struct<name:string,type:string,required:boolean,defaultValue:string,description:string,location:string>>,returnType:string,serviceRef:string,filePath:string,description:string,tags:array<string>,auth:boolean,deprecated:boolean>"
TYPE = "struct<name:string,kind:string,filePath:string,description:string,fields:array<struct<name:string,type:string,required:boolean,description:string>>>"
SERVICE = "struct<name:string,filePath:string,methods:array<string>,dependencies:array<string>,description:string>"
ENTITY = "struct<name:string,tableName:string,dbType:string,columns:array<struct<name:string,type:string,nullable:boolean,primaryKey:boolean>>,relations:array<struct<type:string,target:string,joinColumn:string>>,indexes:array<string>,filePath:string,description:string>"
DEPENDENCY = "struct<source:string,target:string,type:string>"
RESULT = f"struct<endpoints:array<{ENDPOINT}>,types:array<{TYPE}>,services:array<{SERVICE}>,entities:array<{ENTITY}>,dependencies:array<{DEPENDENCY}>>"


def read_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The collections of analysis results in JSON files, bare or as the first of ``results``."""
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<results:array<{RESULT}>>")["results"]
    one = F.coalesce(F.try_element_at(wrapped, F.lit(1)), F.from_json("value", RESULT))
    rows = raw.select(one.alias("r")).where("r is not null")
    return {c: rows.select(F.explode(f"r.{c}").alias("x")).select("x.*") for c in ("endpoints", "types", "services", "entities", "dependencies")}


def merged(results: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The collections of several results together; missing columns are null."""
    return {c: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r[c] for r in results if c in r]) for c in {c: None for r in results for c in r}}


def write_pages(pages: DataFrame, folder: str) -> None:
    """One text per page (path, content), in a folder per path: ``folder/path=.../part``."""
    pages.where("path is not null").select("path", F.coalesce("content", F.lit("")).alias("value")).write.mode("overwrite").partitionBy("path").option("lineSep", "\u0000").text(folder)


def write_search_index(pages: DataFrame, folder: str, chars: int = 2000) -> None:
    """The index of a site's search (slug, title, text, headings) as JSON lines; the text of a page without markup is cut after ``chars``, which is the index' feature."""
    headings = F.transform(F.regexp_extract_all("content", F.lit(r"(?m)^#{2,3} +([^\n]*)"), 1), lambda h: F.trim(h, F.lit(" \r")))
    plain = F.substring(T.strip_tags(F.col("content")), 1, chars)
    pages.where("path is not null").select(F.regexp_replace("path", r"\.md$", "").alias("slug"), "title", plain.alias("text"), headings.alias("headings")).write.mode("overwrite").json(folder)
