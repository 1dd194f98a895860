"""Queries that extract endpoints, types, services and dependencies from source files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from ..tables import read
from .base import Book

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle


def text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


EXT = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))"


def rule_sql(rule: extract.Rule, more: str = "") -> str:
    """One rule in SQL: all whole matches, then each group out of its match."""
    group = lambda w: f"nullif(regexp_extract(m, {text(rule.pattern)}, {w}), '')" if isinstance(w, int) else (text(w) if w else "null::varchar")
    cols = ", ".join(f"{group(getattr(rule, k))} as {k}" for k in "abcd")
    fits = f"{EXT} in ({', '.join(text(e) for e in rule.extensions)}) and contains(content, {text(rule.mark)})"
    return f"select file_id, {more}{text(rule.name)} as rule, {cols} from (select *, unnest(regexp_extract_all(content, {text(rule.pattern)}, 0)) as m from source_files where {fits})"


def rules_sql(rules: tuple[extract.Rule, ...], more: str = "") -> str:
    return " union all ".join(rule_sql(r, more) for r in rules)


def first_sql(rules: tuple[extract.Rule, ...]) -> str:
    one = lambda r: f"case when {EXT} in ({', '.join(text(e) for e in r.extensions)}) and contains(content, {text(r.mark)}) then nullif(regexp_extract(content, {text(r.pattern)}, 1), '') end"
    return "coalesce(" + ", ".join(one(r) for r in rules) + ")"


@BOOK.query(
    f"with r as ({rules_sql(extract.ENDPOINTS, f'repo, {first_sql(extract.BASES)} as base, nullif(regexp_extract(content, {text(extract.CLASS)}, 1), {text(str())}) as handler_class, ')}) "
    + r"""select file_id, repo, rule as framework, upper(a) as method, '/' || trim(regexp_replace(concat_ws('/', trim(coalesce(base, ''), '/'), trim(coalesce(b, ''), '/')), '/+', '/', 'g'), '/') as path, c as handler, handler_class, d as parameters from r where rule <> 'graphql'
union all select file_id, repo, rule, a, f, f, null, null from (select *, unnest(regexp_extract_all(b, '(?m)^\s+(\w+)(?:\([^)]*\))?\s*:', 1)) as f from r where rule = 'graphql')"""
)
def extract_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and operations in source files, of all frameworks known."""
    return extract.endpoints(read(spark, sf_dir, "source_files"))


@BOOK.query(f"select file_id, rule, a as kind, b as name, length(c) as body_chars from ({rules_sql(extract.TYPES)})")
def extract_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces, classes, records, structs, enums and functions in source files."""
    rows = extract.extract(read(spark, sf_dir, "source_files"), extract.TYPES)
    return rows.select("file_id", "rule", F.col("a").alias("kind"), F.col("b").alias("name"), F.length("c").cast("bigint").alias("body_chars"))


def fields_sql() -> str:
    one = lambda rule, p, first: f"select file_id, rule, b as name, regexp_extract(m, {text(p)}, {2 if first else 1}) as field, trim(regexp_extract(m, {text(p)}, {1 if first else 2}), ' ' || chr(13)) as type from (select *, unnest(regexp_extract_all(c, {text(p)}, 0)) as m from t where rule = {text(rule)})"
    return f"with t as ({rules_sql(extract.TYPES)}) " + " union all ".join(one(r, p, first) for r, (p, first) in extract.FIELDS.items())


@BOOK.query(fields_sql())
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the types in source files."""
    return extract.fields(extract.extract(read(spark, sf_dir, "source_files"), extract.TYPES))


@BOOK.query(f"select file_id, rule, a as part, b as name, c as type from ({rules_sql(extract.ENTITIES)})")
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the mappers known, with their columns, relations and indexes."""
    rows = extract.extract(read(spark, sf_dir, "source_files"), extract.ENTITIES)
    return rows.select("file_id", "rule", F.col("a").alias("part"), F.col("b").alias("name"), F.col("c").alias("type"))


@BOOK.query(f"select file_id, rule, a as name from ({rules_sql(extract.SERVICES)})")
def extract_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services, repositories, controllers, hooks and stores in source files."""
    return extract.extract(read(spark, sf_dir, "source_files"), extract.SERVICES).select("file_id", "rule", F.col("a").alias("name"))


@BOOK.query(f"select distinct file_id, a as source, unnest(regexp_extract_all(b, ':\\s*([A-Z]\\w+)', 1)) as target from ({rules_sql(extract.SERVICES)}) where b is not null")
def extract_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the constructors of services take."""
    return extract.injected(extract.extract(read(spark, sf_dir, "source_files"), extract.SERVICES)).distinct()


HEADERS = ", ".join(text(h + ".h") for h in extract.STANDARD_HEADERS)


@BOOK.query(f"select distinct file_id, a as kind, b as target from ({rules_sql(extract.DEPENDENCIES)}) where not (rule = 'c_system' and (b in ({HEADERS}) or starts_with(b, 'sys/')))")
def extract_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, includes, uses and parents, the standard library's headers left out."""
    rows = extract.extract(read(spark, sf_dir, "source_files"), extract.DEPENDENCIES)
    standard = (F.col("rule") == "c_system") & (F.col("b").isin(*[h + ".h" for h in extract.STANDARD_HEADERS]) | F.startswith("b", F.lit("sys/")))
    return rows.where(~standard).select("file_id", F.col("a").alias("kind"), F.col("b").alias("target")).distinct()


@BOOK.query(
    f"with r as ({rules_sql(extract.ENDPOINTS)}) "
    + r"""select file_id, c as handler, regexp_extract(p, '(\w+)\s*\??\s*:\s*((?:[^,<\[=]|<[^>]*>|\[[^\]]*\])+)', 1) as name, trim(regexp_extract(p, '(\w+)\s*\??\s*:\s*((?:[^,<\[=]|<[^>]*>|\[[^\]]*\])+)', 2)) as type
from (select *, unnest(regexp_extract_all(d, '(\w+)\s*\??\s*:\s*((?:[^,<\[=]|<[^>]*>|\[[^\]]*\])+)', 0)) as p from r where rule in ('fastapi', 'nestjs', 'spring_kotlin') and d is not null)
union all select file_id, c, regexp_extract(p, '\??([\w\\]+)\s+\$(\w+)', 2), regexp_extract(p, '\??([\w\\]+)\s+\$(\w+)', 1) from (select *, unnest(regexp_extract_all(d, '\??([\w\\]+)\s+\$(\w+)', 0)) as p from r where rule = 'symfony' and d is not null)
union all select file_id, c, regexp_extract(p, '([\w.]+(?:<[^>]*>)?(?:\[\])?)\s+(\w+)', 2), regexp_extract(p, '([\w.]+(?:<[^>]*>)?(?:\[\])?)\s+(\w+)', 1) from (select *, unnest(regexp_extract_all(d, '([\w.]+(?:<[^>]*>)?(?:\[\])?)\s+(\w+)', 0)) as p from r where rule = 'spring' and d is not null)"""
)
def extract_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of the handlers of routes."""
    rows = extract.extract(read(spark, sf_dir, "source_files"), extract.ENDPOINTS).where("d is not null")
    kinds = (
        (("fastapi", "nestjs", "spring_kotlin"), r"(\w+)\s*\??\s*:\s*((?:[^,<\[=]|<[^>]*>|\[[^\]]*\])+)", 1, 2),
        (("symfony",), r"\??([\w\\]+)\s+\$(\w+)", 2, 1),
        (("spring",), r"([\w.]+(?:<[^>]*>)?(?:\[\])?)\s+(\w+)", 2, 1),
    )
    found = F.array()
    for rules, p, n, t in kinds:
        found = F.when(F.col("rule").isin(*rules), F.transform(F.regexp_extract_all("d", F.lit(p), 0), extract.pair_of(p, n, t, " "))).otherwise(found)
    return rows.select("file_id", F.col("c").alias("handler"), F.explode(found).alias("p")).select("file_id", "handler", "p.*")
