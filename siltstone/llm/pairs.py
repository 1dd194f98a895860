"""Functions and types paired with their documentation (problem 6).

Every file is lexed once; that pass gives the file's origin (problem 1), whether
it parses (problem 5) and its symbols: qualified name, normalised signature,
body, documentation. Declarations without a body, as in headers and
interfaces, are joined to their definitions across the files of a repository by
owner, name and signature, so that overloads find their own. Then definitions
without worthwhile documentation are dropped.

Nulls: rows without content or of an unknown language have no functions. A null
repository meets no other. Null or empty documentation is trivial. Repeated
rows are kept, each under its own id; two functions of one name in one class
give one row. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import functions, grammar, lexing, prose, provenance
from .stages import lexed_files, run_batches

SYMBOL = "struct<owner:string,name:string,signature:string,body:boolean,doc:string,from:int,to:int,code:string>"
SCHEMA = f"file_id bigint, repo string, path string, kind string, units {provenance.UNITS}, broken boolean, symbols array<{SYMBOL}>"


def _file(file_id: int, repo: str, path: str, x: lexing.Lexed) -> list[tuple]:
    code = lexing.skeleton(x.text, x.spans)
    kind, units = provenance.origin(path, x.text, x.spans, code)
    own = lexing.language_of(path)
    if own is None:
        broken = False
    elif own == x.lang:
        broken = grammar.broken(x)
    else:
        broken = grammar.broken(lexing.lexed(own, x.text, grammar.note))
    wanted = not broken and kind in (None, "third_party")
    return [(file_id, repo, path, kind, units, broken, functions.extract(x.lang, x.text, x.spans) if wanted else [])]


def _file_with_code(file_id: int, repo: str, path: str, x: lexing.Lexed) -> list[tuple]:
    rows = _file(file_id, repo, path, x)
    for s in rows[0][-1]:
        if s["body"]:
            s["code"] = x.text[s["from"] : s["to"]]
    return rows


def symbols(source_files: DataFrame, with_code: bool = False) -> DataFrame:
    """(file_id, repo, path, owner, name, signature, body, doc, from, to, code) of all functions in hand-written files that parse; ``code`` null without ``with_code``."""
    files = lexed_files(source_files, ["file_id", "repo", "path"], _file_with_code if with_code else _file, SCHEMA, note=grammar.note)
    kept = provenance.with_origin(files).where("kind is null and not broken")
    return kept.select("file_id", "repo", "path", F.explode("symbols").alias("s")).select("file_id", "repo", "path", "s.*")


def documented(found: DataFrame) -> DataFrame:
    """Definitions with worthwhile documentation: (file_id, repo, path, owner, name, signature, from, to, code, doc, doc_from); from, to and code where ``found`` has them.

    ``doc_from`` is 'own', or 'declaration' where only a separate declaration
    of the same signature is documented; of several such the first by text.
    """
    at = ["repo", "owner", "name", "signature"]
    declared = found.where("not body and doc is not null").groupBy(*at).agg(F.min("doc").alias("declared"))
    joined = found.where("body").join(declared, at, "left")
    doc_from = F.when(F.col("doc").isNotNull(), "own").otherwise("declaration")
    place = [c for c in ("from", "to", "code") if c in found.columns]
    return joined.where("doc is not null or declared is not null").select("file_id", "repo", "path", "owner", "name", "signature", *place, F.coalesce("doc", "declared").alias("doc"), doc_from.alias("doc_from"))


def documented_types(type_infos: DataFrame) -> DataFrame:
    """(type_id, name, description) of the types whose description is not trivial."""
    work = lambda i, name, text: [] if prose.is_trivial(text, name) else [(i, name, text)]
    return run_batches(type_infos.select("type_id", "name", "description"), work, "type_id bigint, name string, description string")


def _type_code(kind: str | None, name: str | None, fields: list[dict] | None) -> str:
    lines = [f"  {f['name']}{'' if f['required'] else '?'}: {f['type'] or 'unknown'};" for f in fields or [] if f and f["name"]]
    return "\n".join([f"{kind or 'type'} {name or ''} {{", *lines, "}"])


def types_with_code(type_infos: DataFrame) -> DataFrame:
    """(type_id, repo, path, name, code, doc) of the types whose description is not trivial; ``code`` is written from their kind, name and fields."""
    work = lambda i, repo, path, kind, name, text, fields: [] if prose.is_trivial(text, name) else [(i, repo, path, name, _type_code(kind, name, fields), text)]
    rows = type_infos.select("type_id", "repo", "filePath", "kind", "name", "description", "fields")
    return run_batches(rows, work, "type_id bigint, repo string, path string, name string, code string, doc string")


def pairs(source_files: DataFrame, type_infos: DataFrame) -> DataFrame:
    """(record, record_id, repo, path, owner, name, signature, from_char, to_char, code, doc, doc_from) of functions and types; types have no place or signature."""
    own = documented(symbols(source_files, with_code=True)).withColumnsRenamed({"file_id": "record_id", "from": "from_char", "to": "to_char"}).withColumn("record", F.lit("function"))
    types = types_with_code(type_infos).withColumnRenamed("type_id", "record_id").withColumns({"record": F.lit("type"), "owner": F.lit(""), "doc_from": F.lit("own")})
    order = ["record", "record_id", "repo", "path", "owner", "name", "signature", "from_char", "to_char", "code", "doc", "doc_from"]
    return own.unionByName(types, allowMissingColumns=True).select(*order)


def found(source_files: DataFrame, endpoints: DataFrame, type_infos: DataFrame) -> DataFrame:
    """(record, record_id, owner, name): documented functions, be it by a separate declaration, those that handle an endpoint once more, and types."""
    # Of the documentation only whether there is any goes on.
    table = symbols(source_files).select("file_id", "repo", "path", "owner", "name", "signature", "body", F.when(F.col("doc").isNotNull(), "").alias("doc"))
    # Declarations without documentation say nothing of a definition.
    own = cut(documented(cut(table.where("body or doc is not null"))).select("file_id", "repo", "path", "owner", "name").distinct())
    handlers = endpoints.select(F.col("project").alias("repo"), F.col("filePath").alias("path"), "handler").where("handler is not null").distinct()
    handled = own.withColumn("handler", F.concat("owner", F.lit("."), "name")).join(handlers, ["repo", "path", "handler"], "left_semi")
    rows = lambda df, record, key, owner: df.select(F.lit(record).alias("record"), F.col(key).alias("record_id"), owner.alias("owner"), "name")
    types = rows(documented_types(type_infos), "type", "type_id", F.lit(""))
    return rows(own, "function", "file_id", F.col("owner")).unionByName(rows(handled, "handler", "file_id", F.col("owner"))).unionByName(types)
