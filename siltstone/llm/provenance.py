"""Generated, minified, third-party and bulk data files (problem 1), and their share with shared lexing results.

Each file is lexed, its layout held against its canonical formatting
(:mod:`siltstone.llm.layout`), and its canonical code cut into pieces. Pieces
that occur in several repositories show copies of third-party code that carry
no mark: a file is one if most of its statements occur elsewhere.

Nulls: a file without content or of an unknown language is hand-written (it is
not returned). Empty files are hand-written. Repeated rows are each judged and
returned. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layout, lexing
from .stages import lexed_files

#: Share of a file's statements that lie in pieces known from another repository.
COPIED_SHARE = 0.6
#: Files of fewer statements than this are too short to be known as copies.
LEAST_STATEMENTS = 12
UNITS = "array<struct<h:bigint,w:int>>"
SCHEMA = f"file_id bigint, repo string, path string, kind string, units {UNITS}"


def origin(path: str | None, text: str, spans: list, code: str) -> tuple[str | None, list[dict]]:
    """Kind by layout, and pieces for the comparison with other repositories; none where the kind is known."""
    squeezed = layout.squeeze(code)
    kind = layout.kind_of(layout.features(path, text, spans, code, squeezed))
    # Layout says nothing of the copies of third parties: their marks may be gone in another copy.
    wanted = kind is None or kind == "third_party"
    return kind, [{"h": h, "w": w} for h, w in layout.units(squeezed)] if wanted else []


def _file(file_id: int, repo: str, path: str, x: lexing.Lexed) -> list[tuple]:
    kind, units = origin(path, x.text, x.spans, lexing.skeleton(x.text, x.spans))
    return [(file_id, repo, path, kind, units)]


def copied_shares(files: DataFrame) -> DataFrame:
    """(file_id, copied): share of the statements of a file that occur in another repository too.

    ``files`` has file_id, repo, units. Per piece only the smallest and the
    largest repository are kept, with map-side combining, so that a piece that
    is in a third of all files costs no more than any other.
    """
    pieces = files.select("file_id", "repo", F.explode("units").alias("u")).select("file_id", "repo", "u.h", "u.w")
    spread = pieces.groupBy("h").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi")).where("lo < hi").select("h")
    shared = pieces.join(spread, "h", "left_semi").groupBy("file_id").agg(F.sum("w").alias("shared"))
    return shared


def with_origin(files: DataFrame) -> DataFrame:
    """``files`` (file_id, repo, kind, units, ...) with ``kind`` completed by third-party copies; drops ``units``."""
    total = F.aggregate("units", F.lit(0), lambda acc, u: acc + u["w"])
    found = files.join(copied_shares(files), "file_id", "left")
    copied: Column = (total >= LEAST_STATEMENTS) & (F.coalesce("shared", F.lit(0)) >= COPIED_SHARE * total)
    return found.withColumn("kind", F.when(F.col("kind").isNull() & copied, "third_party").otherwise(F.col("kind"))).drop("units", "shared")


def classify_files(source_files: DataFrame) -> DataFrame:
    """(file_id, repo, path, kind) of every file; ``kind`` is null where it is hand-written."""
    lexed = lexed_files(source_files, ["file_id", "repo", "path"], _file, SCHEMA)
    return with_origin(lexed)
