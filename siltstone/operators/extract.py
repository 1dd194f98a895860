"""Endpoints, types, services and dependencies out of source text, by tables of rules.

A rule names the files that it looks at, a mark that they must hold and a
pattern whose groups are the columns. All rules run in one projection over the
files, each only where extension and mark fit, so that extraction is one scan
without a shuffle. What a row belongs to (a controller's path, a class) is the
first one of its file. Patterns look at text, not at syntax: matches in comments
and literals count too.

Nulls: a file without content or path gives no rows. Repeated files each give
their rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``a`` to ``d`` say what the groups of ``pattern`` are: a group's number, or a fixed text."""

    name: str
    extensions: tuple[str, ...]
    mark: str
    pattern: str
    a: int | str = ""
    b: int | str = ""
    c: int | str = ""
    d: int | str = ""


VERBS = "get|post|put|patch|delete"
UPPER = "GET|POST|PUT|PATCH|DELETE"
CAPITAL = "Get|Post|Put|Patch|Delete"
Q = "[\"'`]"
NOT_Q = "([^\"'`\\n]*)"
ANNOTATED = r"\s*(?:@[^\n]*\n\s*)*"
#: Endpoints: a method, b path, c handler, d parameters.
ENDPOINTS = (
    Rule("fastapi", ("py",), "@", rf"@(?:app|router)\.({VERBS})\(\s*{Q}{NOT_Q}{Q}[^\n]*\)\s*\n\s*(?:@[^\n]*\n\s*)*(?:async )?def (\w+)\(([^)]*)\)", 1, 2, 3, 4),
    Rule("strawberry", ("py",), "strawberry", r"@strawberry\.(field|mutation|subscription)[^\n]*\n\s*(?:async )?def (\w+)\(([^)]*)\)", 1, 2, 2, 3),
    Rule("spring", ("java",), "Mapping", rf"@({CAPITAL})Mapping(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?(?:\"([^\"\n]*)\")?[^)\n]*\))?{ANNOTATED}(?:(?:public|protected|private)\s+)?[\w<>\[\], .?]+?\s+(\w+)\s*\(([^)]*)\)", 1, 2, 3, 4),
    Rule("spring_kotlin", ("kt",), "Mapping", rf"@({CAPITAL})Mapping(?:\(\s*(?:\"([^\"\n]*)\")?[^)\n]*\))?{ANNOTATED}(?:(?:suspend|private|public|internal|protected|override|open)\s+)*fun\s+(\w+)\s*\(([^)]*)\)", 1, 2, 3, 4),
    Rule("dgs", ("kt", "java"), "@Dgs", r"@Dgs(Query|Mutation|Subscription)[^\n]*\n\s*(?:suspend\s+)?fun\s+(\w+)\s*\(([^)]*)\)", 1, 2, 2, 3),
    Rule("nestjs", ("ts",), "@", rf"@({CAPITAL})\(\s*(?:{Q}{NOT_Q}{Q})?\s*\){ANNOTATED}(?:(?:public|private|protected|async)\s+)*(\w+)\s*\(([^)]*)\)", 1, 2, 3, 4),
    Rule("nestjs_graphql", ("ts",), "@Resolver", rf"@(Query|Mutation|Subscription)\([^\n]*\){ANNOTATED}(?:async\s+)?(\w+)\s*\(([^)]*)\)", 1, 2, 2, 3),
    Rule("websocket", ("ts",), "@SubscribeMessage", rf"@SubscribeMessage\(\s*{Q}{NOT_Q}{Q}\s*\){ANNOTATED}(?:async\s+)?(\w+)\s*\(([^)]*)\)", "message", 1, 2, 3),
    Rule("express", ("js", "ts"), "(", rf"\b(?:app|router)\.({VERBS})\(\s*{Q}{NOT_Q}{Q}\s*,\s*(?:[\w.]+\s*,\s*)*([\w.]+)\s*\)", 1, 2, 3),
    Rule("gin", ("go",), "gin.", rf"\.({UPPER})\(\s*\"([^\"\n]*)\"\s*,\s*(?:[\w.]+\(?\)?,\s*)*([\w.]+)\)", 1, 2, 3),
    Rule("echo", ("go",), "echo.", rf"\.({UPPER})\(\s*\"([^\"\n]*)\"\s*,\s*([\w.]+)", 1, 2, 3),
    Rule("fiber", ("go",), "fiber.", rf"\.({CAPITAL})\(\s*\"([^\"\n]*)\"\s*,\s*([\w.]+)", 1, 2, 3),
    Rule("chi", ("go",), "chi.", rf"\.({CAPITAL})\(\s*\"([^\"\n]*)\"\s*,\s*([\w.]+)", 1, 2, 3),
    Rule("gorilla", ("go",), "mux.", r"HandleFunc\(\s*\"([^\"\n]*)\"\s*,\s*([\w.]+)\)\.Methods\(\s*\"(\w+)\"", 3, 1, 2),
    Rule("net_http", ("go",), "http.HandleFunc", r"http\.HandleFunc\(\s*\"([^\"\n]*)\"\s*,\s*([\w.]+)", "GET", 1, 2),
    Rule("laravel", ("php",), "Route::", rf"Route::({VERBS})\(\s*{Q}{NOT_Q}{Q}\s*,\s*\[?([\w\\]+)(?:::class)?", 1, 2, 3),
    Rule("symfony", ("php",), "#[Route", rf"#\[Route\(\s*'([^'\n]*)'[^\n\]]*methods:\s*\[\s*'(\w+)'[^\n]*\]\s*(?:#\[[^\n]*\s*)*(?:public|protected|private)?\s*function\s+(\w+)\s*\(([^)]*)\)", 2, 1, 3, 4),
    Rule("symfony_comment", ("php",), "@Route(", r"@Route\(\s*\"([^\"\n]*)\"[^)\n]*methods=\{\"(\w+)\"\}[^\n]*\n[^/]*\*/\s*(?:public\s+)?function\s+(\w+)\s*\(([^)]*)\)", 2, 1, 3, 4),
    Rule("slim", ("php",), "$app->", rf"\$app->({VERBS})\(\s*{Q}{NOT_Q}{Q}\s*,\s*{Q}?([\w\\:]+)", 1, 2, 3),
    Rule("codeigniter", ("php",), "$routes->", rf"\$routes->({VERBS})\(\s*{Q}{NOT_Q}{Q}\s*,\s*{Q}([\w\\:]+){Q}", 1, 2, 3),
    Rule("crow", ("cpp", "cc"), "CROW_ROUTE", r"CROW_ROUTE\(\s*\w+\s*,\s*\"([^\"\n]*)\"\)(?:\.methods\(\s*(?:crow::HTTPMethod::|\")(\w+))?", 2, 1),
    Rule("pistache", ("cpp", "cc"), "Routes::", rf"Routes::({CAPITAL})\(\s*\w+\s*,\s*\"([^\"\n]*)\"\s*,\s*Routes::bind\(&([\w:]+)", 1, 2, 3),
    Rule("drogon", ("cpp", "h"), "ADD_METHOD_TO", r"ADD_METHOD_TO\(\s*([\w:]+)\s*,\s*\"([^\"\n]*)\"\s*,\s*(\w+)", 3, 2, 1),
    Rule("httplib", ("cpp", "cc"), "httplib", rf"\.({CAPITAL})\(\s*(?:R)?\"\(?([^\"\n)]*)\)?\"\s*,\s*", 1, 2),
    Rule("graphql", ("graphql",), "type ", r"(?m)^(?:extend )?type (Query|Mutation|Subscription) \{([^}]*)\}", 1, 2),
    Rule("sveltekit", ("ts", "js"), "export", rf"export (?:async )?(?:function|const) ({UPPER})\b", 1),
)
#: The path that a file's first controller puts before its routes.
BASES = (
    Rule("fastapi", ("py",), "APIRouter", rf"APIRouter\([^)\n]*prefix\s*=\s*{Q}{NOT_Q}{Q}", 1), Rule("spring", ("java",), "@RequestMapping", r"@RequestMapping\(\s*(?:value\s*=\s*)?\"([^\"\n]*)\"", 1), Rule("spring_kotlin", ("kt",), "@RequestMapping", r"@RequestMapping\(\s*\"([^\"\n]*)\"", 1),
    Rule("nestjs", ("ts",), "@Controller", rf"@Controller\(\s*{Q}{NOT_Q}{Q}", 1), Rule("symfony", ("php",), "#[Route", r"#\[Route\(\s*'([^'\n]*)'[^\n]*\]\s*(?:final\s+)?class", 1), Rule("gin", ("go",), ".Group(", r"\.Group\(\s*\"([^\"\n]*)\"", 1), Rule("echo", ("go",), ".Group(", r"\.Group\(\s*\"([^\"\n]*)\"", 1),
    Rule("fiber", ("go",), ".Group(", r"\.Group\(\s*\"([^\"\n]*)\"", 1), Rule("laravel", ("php",), "prefix(", rf"prefix\(\s*{Q}{NOT_Q}{Q}", 1),
)
#: The class around: the first one of a file.
CLASS = r"(?m)^(?:export |public |final |abstract |default )*class (\w+)"
#: Types: a kind, b name, c body.
TYPES = (
    Rule("ts_interface", ("ts", "tsx"), "interface ", r"(?m)^(?:export )?interface (\w+)[^{\n]*\{([^}]*)\}", "interface", 1, 2), Rule("ts_enum", ("ts",), "enum ", r"(?m)^(?:export )?enum (\w+) \{([^}]*)\}", "enum", 1, 2), Rule("ts_type", ("ts",), "type ", r"(?m)^(?:export )?type (\w+)[^=\n]*= \{([^}]*)\}", "type", 1, 2),
    Rule("ts_class", ("ts",), "class ", r"(?m)^export class (\w+(?:Dto|Input|Request|Response))\b[^{\n]*\{([^}]*)\}", "dto", 1, 2), Rule("prisma", ("ts",), "Prisma.", r"type (\w+) = Prisma\.(\w+)GetPayload", "prisma", 1, 2), Rule("react_props", ("tsx",), "Props", r"(?m)^(?:export )?(?:interface|type) (\w+Props)\b[^{\n]*\{([^}]*)\}", "props", 1, 2),
    Rule("react_component", ("tsx", "jsx"), "<", r"(?m)^export (?:default )?function ([A-Z]\w*)\(([^)]*)\)", "component", 1, 2), Rule("react_context", ("tsx", "ts"), "createContext", r"const (\w+) = (?:React\.)?createContext", "context", 1),
    Rule("pydantic", ("py",), "BaseModel", r"(?m)^class (\w+)\((?:\w+, )*BaseModel\):\n((?:    [^\n]*\n|\s*\n)*)", "model", 1, 2), Rule("python_enum", ("py",), "Enum", r"(?m)^class (\w+)\((?:\w+, ?)?Enum\):\n((?:    [^\n]*\n)*)", "enum", 1, 2),
    Rule("java_record", ("java",), "record ", r"\brecord (\w+)\(([^{]*)\)\s*(?:implements [^{]*)?\{", "record", 1, 2), Rule("java_enum", ("java",), "enum ", r"\benum (\w+)[^{\n]*\{([^}]*)\}", "enum", 1, 2), Rule("java_interface", ("java",), "interface ", r"(?m)^\s*(?:public )?interface (\w+)", "interface", 1),
    Rule("kotlin_data", ("kt",), "data class", r"data class (\w+)\(([^)]*)\)", "data", 1, 2), Rule("kotlin_enum", ("kt",), "enum class", r"enum class (\w+)[^{\n]*\{([^}]*)\}", "enum", 1, 2), Rule("kotlin_sealed", ("kt",), "sealed class", r"sealed class (\w+)", "sealed", 1),
    Rule("go_struct", ("go",), "struct", r"(?m)^type (\w+) struct \{([^}]*)\}", "struct", 1, 2), Rule("go_interface", ("go",), "interface", r"(?m)^type (\w+) interface \{([^}]*)\}", "interface", 1, 2), Rule("go_iota", ("go",), "iota", r"(?m)^type (\w+) int\s*\n+const \(([^)]*)\)", "enum", 1, 2),
    Rule("php_class", ("php",), "class ", r"(?m)^(?:final |abstract |readonly )*class (\w+)", "class", 1), Rule("php_interface", ("php",), "interface ", r"(?m)^interface (\w+)", "interface", 1), Rule("php_enum", ("php",), "enum ", r"(?m)^enum (\w+)[^{]*\{([^}]*)\}", "enum", 1, 2),
    Rule("c_struct", ("c", "h"), "struct ", r"(?m)^(?:typedef )?struct (\w+) \{([^}]*)\}", "struct", 1, 2), Rule("c_typedef_struct", ("c", "h"), "typedef", r"(?m)^typedef struct \{([^}]*)\} (\w+);", "struct", 2, 1), Rule("c_enum", ("c", "h"), "enum ", r"(?m)^(?:typedef )?enum (\w+) \{([^}]*)\}", "enum", 1, 2),
    Rule("c_typedef", ("c", "h"), "typedef", r"(?m)^typedef ([\w *]+?) \*?(\w+);", "alias", 2, 1), Rule("c_function_pointer", ("c", "h"), "typedef", r"(?m)^typedef ([\w *]+?) \(\*(\w+)\)\(", "function_pointer", 2, 1), Rule("c_macro", ("c", "h"), "#define", r"(?m)^#define (\w+)\(([^)\n]*)\)", "macro", 1, 2),
    Rule("c_function", ("c",), "(", r"(?m)^(?:static )?(?:const )?(?:unsigned |struct )?\w+ \*?(\w+)\(([^)]*)\)\s*\{", "function", 1, 2),
    Rule("cpp_class", ("cpp", "hpp", "cc"), "class ", r"(?m)^class (\w+)[^{;\n]*\{", "class", 1), Rule("cpp_struct", ("cpp", "hpp", "cc"), "struct ", r"(?m)^struct (\w+)[^{;\n]*\{([^}]*)\}", "struct", 1, 2), Rule("cpp_enum", ("cpp", "hpp", "cc"), "enum ", r"(?m)^enum (?:class |struct )?(\w+)[^{;\n]*\{([^}]*)\}", "enum", 1, 2),
    Rule("cpp_template", ("cpp", "hpp", "cc"), "template", r"template\s*<([^>]*)>\s*(?:class|struct) (\w+)", "template", 2, 1),
    Rule("graphql_object", ("graphql",), "type ", r"(?m)^(?:extend )?type (\w+)[^{\n]*\{([^}]*)\}", "object", 1, 2), Rule("graphql_input", ("graphql",), "input ", r"(?m)^input (\w+)[^{\n]*\{([^}]*)\}", "input", 1, 2), Rule("graphql_interface", ("graphql",), "interface ", r"(?m)^interface (\w+)[^{\n]*\{([^}]*)\}", "interface", 1, 2),
    Rule("graphql_enum", ("graphql",), "enum ", r"(?m)^enum (\w+)[^{\n]*\{([^}]*)\}", "enum", 1, 2), Rule("graphql_union", ("graphql",), "union ", r"(?m)^union (\w+)[^=\n]*= ([^\n]*)", "union", 1, 2), Rule("graphql_scalar", ("graphql",), "scalar ", r"(?m)^scalar (\w+)", "scalar", 1),
)
#: Entities and what they hold: a part (entity, column, relation, index), b name, c type or target.
ENTITIES = (
    Rule("sqlalchemy_table", ("py",), "__tablename__", r"class (\w+)\([^)\n]*\):\s*\n\s*__tablename__ = [\"'](\w+)[\"']", "entity", 1, 2), Rule("sqlalchemy_column", ("py",), "Column(", r"(?m)^\s+(\w+)(?:: [^=\n]+)? = (?:mapped_column|Column)\((?:[\"']\w+[\"'], )?(\w+)", "column", 1, 2),
    Rule("sqlalchemy_relation", ("py",), "relationship(", r"(?m)^\s+(\w+)(?:: [^=\n]+)? = relationship\([\"'](\w+)[\"']", "relation", 1, 2), Rule("sqlalchemy_index", ("py",), "__table_args__", r"(?:Index|UniqueConstraint)\(([^)\n]*)\)", "index", 1), Rule("tortoise", ("py",), "fields.", r"(?m)^\s+(\w+) = fields\.(\w+)\(", "column", 1, 2),
    Rule("jpa_entity", ("java", "kt"), "@Entity", r"@Entity\s*(?:@[^\n]*\n\s*)*(?:public )?(?:data )?class (\w+)", "entity", 1), Rule("jpa_column", ("java",), "@Column", r"@Column[^\n]*\n\s*(?:private|protected|public) ([\w<>]+) (\w+);", "column", 2, 1), Rule("jpa_relation", ("java",), "To", r"@(OneToMany|ManyToOne|OneToOne|ManyToMany)[^\n]*\n(?:\s*@[^\n]*\n)*\s*(?:private|protected|public) (?:List|Set)?<?(\w+)>?", "relation", 1, 2),
    Rule("jpa_index", ("java",), "@Index", r"@Index\([^)\n]*columnList\s*=\s*\"([^\"\n]*)\"", "index", 1), Rule("jpa_repository", ("java", "kt"), "Repository<", r"interface (\w+)\s*(?:extends|:)\s*\w*Repository<(\w+)", "repository", 1, 2),
    Rule("typeorm_entity", ("ts",), "@Entity", r"@Entity\(\s*(?:[\"'](\w+)[\"'])?[^)]*\)\s*export class (\w+)", "entity", 2, 1), Rule("typeorm_column", ("ts",), "Column(", r"@(?:Primary(?:Generated)?|CreateDate|UpdateDate|DeleteDate)?Column\([^)]*\)\s*(\w+)[?!]?: ([\w\[\]]+)", "column", 1, 2),
    Rule("typeorm_relation", ("ts",), "To", r"@(OneToMany|ManyToOne|OneToOne|ManyToMany)\(\(\) => (\w+)", "relation", 1, 2), Rule("typeorm_index", ("ts",), "@Index", r"@(?:Index|Unique)\(([^)\n]*)\)", "index", 1), Rule("mongoose", ("ts",), "@Prop", r"@Prop\([^)]*\)\s*(\w+)[?!]?: ([\w\[\]]+)", "column", 1, 2),
    Rule("gorm", ("go",), "gorm:", r"(?m)^\s+(\w+)\s+(\S+)\s+`[^`\n]*gorm:\"([^\"\n]*)\"", "column", 1, 2), Rule("eloquent", ("php",), "extends Model", r"class (\w+) extends Model", "entity", 1), Rule("eloquent_relation", ("php",), "$this->", r"\$this->(hasOne|hasMany|belongsTo|belongsToMany|morphTo|morphOne|morphMany|morphToMany|hasManyThrough)\((\w+)", "relation", 1, 2),
    Rule("doctrine", ("php",), "Column", r"#\[ORM\\Column[^\n]*\]\s*(?:private|protected|public) \??(\w+) \$(\w+)", "column", 2, 1), Rule("graphql_entity", ("graphql",), "@", r"(?m)^type (\w+)[^{\n]*@(entity|key|model)\b", "entity", 1, 2),
)
#: Services: a name, b its constructor's parameters.
SERVICES = (
    Rule("nestjs", ("ts",), "constructor", r"class (\w+(?:Service|Repository|Gateway|Controller))\b[^{]*\{\s*constructor\(([^)]*)\)", 1, 2), Rule("python", ("py",), "__init__", r"class (\w+(?:Service|Repository|Controller))\b[^\n]*:\s*\n\s*def __init__\(([^)]*)\)", 1, 2),
    Rule("java", ("java",), "class ", r"class (\w+(?:Service|Repository|Controller))\b", 1), Rule("kotlin", ("kt",), "class ", r"class (\w+(?:Service|Repository|Controller))\(([^)]*)\)", 1, 2), Rule("kotlin_object", ("kt",), "object ", r"(?m)^object (\w+)", 1), Rule("go", ("go",), "struct", r"(?m)^type (\w+(?:Service|Repository|Controller)) struct \{([^}]*)\}", 1, 2),
    Rule("php", ("php",), "class ", r"class (\w+(?:Service|Repository|Controller))\b", 1), Rule("js", ("js",), "class ", r"class (\w+(?:Service|Repository|Controller))\b", 1), Rule("react_hook", ("ts", "tsx", "js"), "use", r"(?m)^export (?:default )?(?:function|const) (use[A-Z]\w*)", 1), Rule("pinia", ("ts", "js"), "defineStore", r"const (use\w+) = defineStore\([\"'](\w+)", 1, 2),
    Rule("svelte_store", ("ts", "js"), "svelte/store", r"export const (\w+) = (writable|readable|derived)\(", 1, 2), Rule("svelte_load", ("ts", "js"), "load", r"export (?:const|async function|function) (load)\b", 1),
)
#: Dependencies: a kind, b what is used.
DEPENDENCIES = (
    Rule("es_import", ("ts", "tsx", "js", "jsx"), "import", r"(?m)^import [^\n]*?from ['\"]((?:\.|@/)[^'\"\n]+)['\"]", "import", 1), Rule("require", ("js",), "require(", r"require\(['\"](\.[^'\"\n]+)['\"]\)", "import", 1), Rule("python_import", ("py",), "import", r"(?m)^from (\.[\w.]*) import ([^\n]+)", "import", 1),
    Rule("java_import", ("java", "kt"), "import ", r"(?m)^import (?:static )?([\w.]+)", "import", 1), Rule("c_include", ("c", "h"), "#include", r"(?m)^#include \"([^\"\n]+)\"", "include", 1), Rule("c_system", ("c", "h"), "#include", r"(?m)^#include <([^>\n]+)>", "system", 1), Rule("php_use", ("php",), "use ", r"(?m)^use ([\w\\]+);", "use", 1),
    Rule("java_implements", ("java", "php", "ts"), "implements", r"class (\w+)[^{\n]* implements (\w+)", "implement", 2), Rule("java_extends", ("java", "php", "ts", "js"), "extends", r"class (\w+) extends (\w+)", "inherit", 2), Rule("graphql_implements", ("graphql",), "implements", r"type (\w+) implements (\w+)", "implement", 2),
)
#: Standard headers of C that are no dependencies. Fixed values.
STANDARD_HEADERS = "assert ctype errno float inttypes limits locale math pthread setjmp signal stdarg stdbool stddef stdint stdio stdlib string time unistd fcntl dirent".split()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _column(rule: Rule, match: Column, what: int | str) -> Column:
    return F.nullif(F.regexp_extract(match, rule.pattern, what), F.lit("")) if isinstance(what, int) else F.lit(what or None).cast("string")


def _row_of(rule: Rule) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(rule.name).alias("rule"), *[_column(rule, m, getattr(rule, k)).alias(k) for k in "abcd"])


def pair_of(pattern: str, name: int, type_: int, blanks: str = " \r") -> Callable[[Column], Column]:
    """Struct of a name and a type out of a match of ``pattern``, by their groups."""
    return lambda m: F.struct(F.regexp_extract(m, pattern, name).alias("name"), F.trim(F.regexp_extract(m, pattern, type_), F.lit(blanks)).alias("type"))


def extract(files: DataFrame, rules: tuple[Rule, ...], *more: Column) -> DataFrame:
    """(file_id, rule, a, b, c, d) of every match, and the columns ``more`` of the file."""
    ext = extension(F.col("path"))
    found = []
    for rule in rules:
        fits = ext.isin(*rule.extensions) & F.contains("content", F.lit(rule.mark))
        found.append(F.when(fits, F.transform(F.regexp_extract_all("content", F.lit(rule.pattern), 0), _row_of(rule))).otherwise(F.array()))
    rows = files.where("content is not null and path is not null").select("file_id", *more, F.explode(F.concat(*found)).alias("x"))
    return rows.select("file_id", *[F.col(n) for n in rows.columns if n not in ("file_id", "x")], "x.*")


def first_of(rules: tuple[Rule, ...]) -> Column:
    """The first match of a file among ``rules``; null without one."""
    ext = extension(F.col("path"))
    return F.coalesce(*[F.when(ext.isin(*r.extensions) & F.contains("content", F.lit(r.mark)), F.nullif(F.regexp_extract("content", r.pattern, 1), F.lit(""))) for r in rules])


def join_path(base: Column, path: Column) -> Column:
    """``/base/path`` with one slash between the parts and none at the end."""
    parts = F.concat_ws("/", F.trim(base, F.lit("/")), F.trim(path, F.lit("/")))
    return F.concat(F.lit("/"), F.trim(F.regexp_replace(parts, "/+", "/"), F.lit("/")))


def endpoints(files: DataFrame) -> DataFrame:
    """(file_id, repo, framework, method, path, handler, handler_class, parameters) of the routes; the fields of GraphQL's operation types are one row each."""
    base, owner = first_of(BASES).alias("base"), F.nullif(F.regexp_extract("content", CLASS, 1), F.lit("")).alias("handler_class")
    rows = extract(files, ENDPOINTS, F.col("repo"), base, owner)
    graphql = rows.where("rule = 'graphql'").select("file_id", "repo", "rule", F.col("a").alias("method"), F.explode(F.regexp_extract_all("b", F.lit(r"(?m)^\s+(\w+)(?:\([^)]*\))?\s*:"), 1)).alias("path"))
    graphql = graphql.select("file_id", "repo", F.col("rule").alias("framework"), "method", "path", F.col("path").alias("handler"), F.lit(None).cast("string").alias("handler_class"), F.lit(None).cast("string").alias("parameters"))
    rest = rows.where("rule <> 'graphql'").select("file_id", "repo", F.col("rule").alias("framework"), F.upper("a").alias("method"), join_path(F.coalesce("base", F.lit("")), F.coalesce("b", F.lit(""))).alias("path"), F.col("c").alias("handler"), "handler_class", F.col("d").alias("parameters"))
    return rest.unionByName(graphql)


#: Fields in the body of a type: by rule, the pattern of name and type, and whether the type comes first.
FIELDS = {
    "ts_interface": (r"(\w+)\??:\s*([^;\n]+)", False), "ts_type": (r"(\w+)\??:\s*([^;\n]+)", False), "ts_class": (r"(\w+)[?!]?:\s*([^;\n]+)", False), "react_props": (r"(\w+)\??:\s*([^;\n]+)", False), "pydantic": (r"(?m)^    (\w+): ([^=\n]+)", False),
    "java_record": (r"([\w.]+(?:<[^>]*>)?(?:\[\])?) (\w+)(?:,|$)", True), "kotlin_data": (r"va[lr] (\w+): ([\w.]+(?:<[^>]*>)?\??)", False), "go_struct": (r"(?m)^\s+(\w+)\s+([^\s`]+)", False), "c_struct": (r"(\w+) \*?(\w+)(?:\[[^\]]*\])?;", True), "graphql_object": (r"(?m)^\s+(\w+)(?:\([^)]*\))?\s*:\s*([\w\[\]!]+)", False), "graphql_input": (r"(?m)^\s+(\w+)\s*:\s*([\w\[\]!]+)", False),
}


def fields(types: DataFrame) -> DataFrame:
    """(file_id, rule, name, field, type) of the fields of types (file_id, rule, b name, c body)."""
    found = F.array()
    for rule, (pattern, type_first) in FIELDS.items():
        n, t = (2, 1) if type_first else (1, 2)
        found = F.when(F.col("rule") == rule, F.transform(F.regexp_extract_all("c", F.lit(pattern), 0), pair_of(pattern, n, t))).otherwise(found)
    return types.where(F.col("c").isNotNull() & F.col("rule").isin(*FIELDS)).select("file_id", "rule", F.col("b").alias("name"), F.explode(found).alias("f")).select("file_id", "rule", "name", F.col("f.name").alias("field"), "f.type")


def injected(services: DataFrame) -> DataFrame:
    """(file_id, source, target): what the constructors of services take, by the types of their parameters."""
    types = F.regexp_extract_all("b", F.lit(r":\s*([A-Z]\w+)"), 1)
    return services.where("b is not null").select("file_id", F.col("a").alias("source"), F.explode(F.array_distinct(types)).alias("target"))
