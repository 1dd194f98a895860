"""What a repository is made with: languages, frameworks and the extractors that fit, by its files.

Nulls: files without path have no language; files without content hold no mark.
Repeated files count again. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .extract import extension

#: Frameworks by the files that speak for them and the words in them. Fixed values.
FRAMEWORKS = (
    ("FastAPI", "py", r"from fastapi import|import fastapi"), ("Django", "py", r"from django|import django"), ("Flask", "py", r"from flask import"), ("SQLAlchemy", "py", r"from sqlalchemy"), ("Tortoise", "py", r"from tortoise"), ("Strawberry", "py", r"import strawberry"),
    ("Spring Boot", "java", r"@RestController|org\.springframework"), ("Spring Boot (Kotlin)", "kt", r"@RestController|org\.springframework"), ("Hibernate", "java", r"javax\.persistence|jakarta\.persistence"), ("DGS", "kt", r"com\.netflix\.graphql\.dgs"),
    ("NestJS", "ts", r"@nestjs/|@Controller\("), ("Express", "js", r"require\(['\"]express['\"]\)|from ['\"]express['\"]"), ("React", "tsx", r"from ['\"]react['\"]"), ("TypeORM", "ts", r"from ['\"]typeorm['\"]"), ("Prisma", "ts", r"@prisma/client"),
    ("Gin", "go", r"github\.com/gin-gonic/gin"), ("Echo", "go", r"github\.com/labstack/echo"), ("Fiber", "go", r"github\.com/gofiber/fiber"), ("Laravel", "php", r"Illuminate\\\\"), ("Symfony", "php", r"Symfony\\\\|#\[Route\("), ("Doctrine", "php", r"Doctrine\\\\"),
    ("GraphQL", "graphql", r"type Query"), ("OpenAPI", "json", r"\"openapi\"\s*:"), ("OpenAPI", "yaml", r"(?m)^openapi:"),
)
#: Extractors by extension, in the order of preference. Fixed values.
PARSERS = (("typescript-nestjs", ("ts",)), ("python-fastapi", ("py",)), ("java-spring", ("java",)), ("kotlin-spring", ("kt", "kts")), ("graphql", ("graphql", "gql")), ("go", ("go",)), ("php", ("php",)), ("c", ("c", "h")), ("cpp", ("cpp", "hpp", "cc")), ("react", ("tsx", "jsx")), ("vue", ("vue",)), ("svelte", ("svelte",)))
#: Folders that don't count. Fixed values.
IGNORED = r"(?:^|/)(?:node_modules|dist|build|\.git)/"


def languages(files: DataFrame) -> DataFrame:
    """(repo, language, files, percent): share of each known language, ignored folders left out."""
    counts = files.where(F.col("path").isNotNull() & ~F.col("path").rlike(IGNORED)).groupBy("repo", T.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files")).where("language <> 'unknown'")
    whole = F.sum("files").over(Window.partitionBy("repo"))  # a row per language
    return counts.withColumn("percent", F.round(100.0 * F.col("files") / whole).cast("bigint"))


def frameworks(files: DataFrame) -> DataFrame:
    """(repo, framework, files, first_file): frameworks that files speak for, with the first file by ``ord``; all rules in one scan."""
    ext = extension(F.col("path"))
    found = F.array_compact(F.array(*[F.when((ext == e) & F.col("content").rlike(p), F.lit(name)) for name, e, p in FRAMEWORKS]))
    rows = files.where("content is not null and path is not null").select("repo", "path", "ord", "file_id", F.explode(F.array_distinct(found)).alias("framework"))
    return rows.groupBy("repo", "framework").agg(F.count("*").alias("files"), F.min_by("path", F.struct("ord", "file_id")).alias("first_file"))


def parsers(files: DataFrame) -> DataFrame:
    """(repo, parser, files, rank): extractors by the number of files they fit; ties in the order of preference."""
    ext = extension(F.col("path"))
    name, order = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0))
    for i, (parser, exts) in enumerate(PARSERS):
        name, order = name.when(ext.isin(*exts), parser), order.when(ext.isin(*exts), i)
    counts = files.where(~F.col("path").rlike(IGNORED)).select("repo", name.alias("parser"), order.alias("i")).where("parser is not null").groupBy("repo", "parser", "i").agg(F.count("*").alias("files"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("files"), "i"))).drop("i")
