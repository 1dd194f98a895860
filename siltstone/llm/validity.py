"""Source files that do not parse (problem 5).

A file is represented by its chunks: maps of lexer states, whose products give
each chunk its true state (:mod:`siltstone.llm.lexing`), and bracket summaries,
made of each chunk and reduced associatively (:mod:`siltstone.llm.grammar`).
Balanced statements are held against local grammars on the way. The parts of a
huge file are lexed and summed up by several tasks (:mod:`siltstone.llm.stages`).
Python and JSON files that pass are parsed exactly by the parsers at hand.

Nulls: a row without content, or whose path has no known extension, is not
judged. Empty files are valid. Repeated rows are each judged. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammar, lexing
from .stages import lexed_files

SCHEMA = "file_id bigint, repo string, language string, broken boolean"


def _file(file_id: int, repo: str, x: lexing.Lexed) -> list[tuple]:
    return [(file_id, repo, x.lang, grammar.broken(x))]


def judge_files(source_files: DataFrame) -> DataFrame:
    """(file_id, repo, language, broken) of every file with a known extension; ``language`` is that of the extension."""
    return lexed_files(source_files, ["file_id", "repo"], _file, SCHEMA, sniff=False, note=grammar.note)


def rates(judged: DataFrame) -> DataFrame:
    """Files, broken files and their rate per repository and language; null repositories form one group."""
    return judged.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum(F.col("broken").cast("bigint")).alias("broken_files")).withColumn("rate", F.col("broken_files") / F.col("files"))
