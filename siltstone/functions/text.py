"""Scalar functions on names, texts, paths and markup, as column expressions.

Null gives null, where not said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in pairs:
        c = F.regexp_replace(c, pattern, by)
    return c


def to_kebab(c: Column) -> Column:
    """``userId`` and ``user id`` become ``user-id``; runs of capitals stay together."""
    return F.lower(_replaced(c, (("([a-z])([A-Z])", "$1-$2"), (r"[\s_]+", "-"))))


def to_snake(c: Column) -> Column:
    """``userId`` becomes ``user_id``: an underscore before each capital, none in front."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "([A-Z])", "_$1")), "^_", "")


def snake_to_camel(c: Column) -> Column:
    """``user_id`` becomes ``UserId``."""
    return F.array_join(F.transform(F.split(c, "_"), capitalize), "")


def capitalize(c: Column) -> Column:
    """First letter upper, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.greatest(F.lit(0), F.length(c) - 1)))


def _literal(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_html(c: Column) -> Column:
    return _literal(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")))


def unescape_html(c: Column) -> Column:
    """Named entities; numeric ones of the Latin letters stay."""
    return _literal(c, (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")))


def escape_markdown(c: Column) -> Column:
    return _literal(c, (("|", "\\|"), ("[", "\\["), ("]", "\\]"), ("`", "\\`")))


def sanitize_id(c: Column) -> Column:
    """All but letters, digits and underscores become underscores."""
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")


def sanitize_type(c: Column) -> Column:
    return F.regexp_replace(c, r"[<>\[\]{}\s]", "_")


def node_id(c: Column) -> Column:
    """Id of a diagram's node: as :func:`sanitize_id`, runs of underscores as one, none at the ends; a name without letters gets a hash."""
    plain = _replaced(c, (("[^a-zA-Z0-9_]", "_"), ("_+", "_"), ("^_|_$", "")))
    return F.when(plain == "", F.concat(F.lit("node_"), F.substring(F.md5(c), 1, 8))).otherwise(plain)


def base_type(c: Column) -> Column:
    """``Promise<User[]>`` gives ``User``: the first name, or the one in its angle brackets."""
    return F.regexp_extract(c, r"(?:\w+<)?(\w+)>?", 1)


def strip_tags(c: Column) -> Column:
    """Text without tags, white space as single blanks."""
    return F.trim(_replaced(c, (("<[^>]+>", " "), (r"[ \t\r\n\f\x0b]+", " "))))


def slug(c: Column) -> Column:
    """Anchor of a heading: lower case, letters (Korean ones too), digits and hyphens; ``heading`` if nothing is left."""
    plain = _replaced(F.trim(F.lower(c)), (("[^a-z0-9_\\s\\-ㄱ-힣]", ""), ("\\s+", "-"), ("-+", "-")))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("heading"))


def front_matter(text: Column) -> Column:
    """Map of the ``key: value`` lines of the block between two ``---`` lines at a text's start; null without one; the last of a key holds."""
    block = F.regexp_extract(text, r"^---\r?\n((?s:.*?))\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))), "^[\"']|[\"']$", "").alias("value"))
    pairs = F.transform(lines, pair)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))
    return F.when(F.startswith(text, F.lit("---")) & (block != ""), F.map_from_entries(last))


def body_of(text: Column) -> Column:
    """A text without its front matter."""
    return F.regexp_replace(text, r"^---\r?\n(?s:.*?)\r?\n---\r?\n?", "")


def sanitize_html(c: Column) -> Column:
    """Markup without scripts, dangerous tags, event handlers and script addresses."""
    return _replaced(
        c,
        (
            (r"(?is)<script\b[^>]*>.*?</script>", ""), (r"(?i)</?(?:iframe|object|embed|form|input|button|link|meta|base)\b[^>]*>", ""),
            (r"(?i)\s+on\w+\s*=\s*\"[^\"]*\"", ""), (r"(?i)\s+on\w+\s*=\s*'[^']*'", ""), (r"(?i)(href|src)\s*=\s*\"\s*javascript:[^\"]*\"", '$1="#"'), (r"(?i)(href|src)\s*=\s*'\s*javascript:[^']*'", "$1='#'"),
        ),
    )


def preserve_mermaid(c: Column) -> Column:
    """Fenced diagrams become divisions."""
    return F.regexp_replace(c, r"(?s)```mermaid\r?\n(.*?)```", '<div class="mermaid">\n$1</div>')


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``{{key}}`` becomes the value; unknown keys stay."""
    c = F.lit(template)
    for k, v in values.items():
        c = F.replace(c, F.lit("{{" + k + "}}"), F.coalesce(v, F.lit("")))
    return c


def format_bytes(n: Column) -> Column:
    """``1.5 KB``: the largest unit of 1,024 below the size, two decimals at most."""
    units = F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB", "TB", "PB")])
    i = F.when(n > 0, F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)) + 1e-12)).otherwise(0).cast("int")
    size = F.regexp_replace(F.format_string("%.2f", F.round(n / F.pow(F.lit(1024.0), i), 2)), r"\.?0+$", "")
    return F.when(n == 0, "0 Bytes").otherwise(F.concat(size, F.lit(" "), F.element_at(units, i + 1)))


def short_path(c: Column) -> Column:
    """The last two segments."""
    return F.substring_index(c, "/", -2)


def module_of(path: Column) -> Column:
    """The folder right above a file, or ``root``."""
    parts = F.split(path, "/")
    return F.when(path.isNotNull(), F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise("root"))


def segment_after(path: Column, folder: str) -> Column:
    """The segment behind ``folder``, ``root`` if a file follows it directly, ``other`` without it."""
    parts = F.split(path, "/")
    at = F.array_position(parts, folder)
    return F.when(at == 0, "other").when(at + 1 >= F.size(parts), "root").otherwise(F.get(parts, at.cast("int")))


def relative_prefix(slug_: Column) -> Column:
    """``../`` for each level of a page."""
    return F.repeat(F.lit("../"), F.length(F.regexp_replace(slug_, "[^/]", "")))


#: Languages by extension. Fixed values.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "go": "go", "php": "php",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "graphql": "graphql", "gql": "graphql", "yaml": "yaml", "yml": "yaml", "json": "json", "vue": "vue", "svelte": "svelte", "md": "markdown",
}


def language_of(path: Column) -> Column:
    """Language of a path's extension; ``unknown`` for any other and for null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def path_params(path: Column) -> Column:
    """Names of the parameters in a route: ``{id}`` and ``:id``."""
    return F.regexp_extract_all(path, F.lit(r"[:{](\w+)\}?"), 1)


def route_of_file(path: Column) -> Column:
    """Route of a page file: ``[...x]`` is a rest, ``[x]`` a parameter; groups in round brackets, the extension and ``index`` are dropped."""
    plain = _replaced(path, ((r"\.\w+$", ""), (r"/\([^)]*\)", ""), (r"(^|/)index$", "$1"), (r"\[\.\.\.(\w+)\]", ":$1*"), (r"\[(\w+)\]", ":$1"), ("/$", "")))
    return F.when(F.startswith(plain, F.lit("/")), plain).otherwise(F.concat(F.lit("/"), plain))


def strip_comments(c: Column) -> Column:
    """C-like code without its comments; literals are not looked at."""
    return _replaced(c, ((r"(?s)/\*.*?\*/", ""), (r"//[^\n]*", "")))


def clean_type(c: Column) -> Column:
    """A type's name without marks of lists, nulls, pointers, references and constness."""
    return F.trim(_replaced(c, ((r"\bconst\b", ""), (r"[\[\]!*&?]", ""), (r"\s+", " "))))


def kind_of_name(name: Column) -> Column:
    """Kind of a type by the words in its name: input, response, dto or type."""
    low = F.lower(name)
    return F.when(low.rlike("input|request|create|update"), "input").when(low.rlike("response|result|output|payload"), "response").when(low.rlike("dto"), "dto").otherwise("type")


def base_kind(literal: Column) -> Column:
    """Type that a default literal stands for."""
    c = F.trim(literal)
    return (
        F.when(c.isin("true", "false"), "boolean").when(c.rlike("^-?\\d+(\\.\\d+)?$"), "number").when(c.rlike("^[\"'`]"), "string").when(F.startswith(c, F.lit("[")), "array").when(F.startswith(c, F.lit("{")), "object")
        .when(c == "null", "null").when(c == "undefined", "undefined").otherwise("unknown")
    )


def tag_value(c: Column, key: str) -> Column:
    """Value of ``key:"..."`` in a struct tag; null without one."""
    return F.nullif(F.regexp_extract(c, rf'\b{key}:"([^"]*)"', 1), F.lit(""))


def request_url(base: Column, path: Column, query: Column) -> Column:
    """Address of a call: every parameter of the path filled with a placeholder of its name, the query's names appended."""
    filled = F.regexp_replace(path, r"[:{](\w+)\}?", "<$1>")
    return F.concat(F.coalesce(base, F.lit("")), filled, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.transform(query, lambda q: F.concat(q, F.lit("=<"), q, F.lit(">"))), "&"))).otherwise(""))


def curl(method: Column, url: Column, auth: Column) -> Column:
    """A command line that calls an endpoint."""
    return F.concat_ws(" \\\n  ", F.concat(F.lit("curl -X "), method, F.lit(" '"), url, F.lit("'")), F.when(auth, F.lit("-H 'Authorization: Bearer <token>'")), F.when(method.isin("POST", "PUT", "PATCH"), F.lit("-H 'Content-Type: application/json'")))
