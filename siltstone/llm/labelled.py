"""Lines of text with a language label, for fitting the language models.

A bounded sample of labelled documents is drawn by a hash of their ids, at most
about ``per_lang`` documents a language. Only the models are fitted on it;
everything is then labelled by them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_rows
from . import prose

#: Other standards' codes of the languages of ``lang_codes``. Fixed values.
OTHER_CODES = {"eng": "en", "kor": "ko", "jpn": "ja", "zho": "zh", "chi": "zh", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "nld": "nl", "dut": "nl", "rus": "ru"}
#: Labelled documents per language that the models are fitted on.
PER_LANG = 150
LINES_PER_DOC = 12
#: Characters of a document of the sample that its lines are taken from.
CHARS_PER_DOC = 20_000


def names_of(lang_codes: DataFrame) -> dict[str, str]:
    """Every spelling of a language -> its code; the table of languages is fixed and small."""
    rows = small_rows(lang_codes.select("code", "name"))
    codes = {r["code"].lower(): r["code"] for r in rows if r["code"]}
    return codes | {r["name"].lower(): r["code"] for r in rows if r["name"] and r["code"]} | {k: v for k, v in OTHER_CODES.items() if v in codes}


def code_of(label: Column, names: dict[str, str]) -> Column:
    """Code of a label in any spelling; null where it names no language."""
    plain = F.lower(F.trim(label))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, F.regexp_extract(plain, "^([a-z]+)[-_]", 1)))


FENCE = re.compile(r"^[ \t>]*(?:(?:[-*+]|\d+[.)])[ \t]+)?(`{3,}|~{3,})")
TABLE = re.compile(r"^[ \t]*\|.*|^[ \t|:+-]*-{2,}[ \t|:+-]*$")
LEAD = re.compile(r"^[ \t]*(?:[-*+>]|\d+[.)]|#{1,6})[ \t]+")
NOISE = re.compile(r"`[^`]*`|<[^<>]*>|https?://\S+|!?\[|\]\([^)]*\)|&\w+;|\*\*|__|[\w.-]+@[\w.-]+|\b\w*[_/.\\]\w[\w./\\]*|\b[a-z]+[A-Z]\w*|\b\w*\d\w*")
#: Letters of scripts that put no blanks between words, or particles right behind one.
UNSPACED = r"\u1100-\u11ff\u3005-\u3007\u3040-\u30ff\u3130-\u318f\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3\uf900-\ufaff\uff66-\uff9f"
W = rf"[^\W{UNSPACED}]"
#: ``NOISE`` for texts with such letters: a number, a path, a name or an address ends where they begin.
NOISE_UNSPACED = re.compile(
    rf"`[^`]*`|<[^<>]*>|https?://[^\s{UNSPACED}\u3001\u3002\u300c-\u3011\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f]+|!?\[|\]\([^)]*\)|&{W}+;|\*\*|__|(?:{W}|[.-])+@(?:{W}|[.-])+"
    rf"|(?<!{W})(?:(?={W})|(?<=[{UNSPACED}])){W}*[_/.\\]{W}(?:{W}|[./\\])*|(?<!{W})[a-z]+[A-Z]{W}*|(?<!{W}){W}*\d{W}*"
)
ANY_UNSPACED = re.compile(rf"[{UNSPACED}]")
#: Every match of ``NOISE`` holds one of these.
SIGN = re.compile(r"[`<\[\]&*_@/\\\d]|[a-z][A-Z]|\.\w")
FOUR_LETTERS = re.compile(r"(?:[^\W\d_][\W\d_]*){4}")
TAG_ONLY = re.compile(r"^[ \t]*(?:</?[A-Za-z!][^<>]*>[ \t]*)+$")


def without_noise(text: str) -> str:
    """Text with a blank for each piece of markup, address, path or name of code."""
    if not SIGN.search(text):
        return text
    return (NOISE_UNSPACED if ANY_UNSPACED.search(text) else NOISE).sub(" ", text)


def prose_lines(text: str) -> list[str]:
    """Lines of prose, without code blocks, tables, front matter, markup."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out, fence, start = [], None, 0
    if lines and lines[0].strip().lstrip("﻿") == "---":
        end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")), 0)
        start = end + 1 if end else 0
    for line in lines[start:]:
        m = FENCE.match(line)
        if m:
            if fence is None:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence):
                fence = None
            continue
        if fence or not line.strip() or TABLE.match(line) or TAG_ONLY.match(line) or re.match(r"(?: {4}|\t)\s*[^\s*+\-\d]", line) and re.search(r"[;{}()=]\s*$", line):
            continue
        plain = without_noise(LEAD.sub("", line)).strip()
        if FOUR_LETTERS.search(plain):
            out.append(plain)
    return out


def sample(documents: DataFrame, lang_codes: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """(line, language) of at most about ``per_lang`` documents a language; ``LINES_PER_DOC`` lines of each."""
    names = names_of(lang_codes)
    docs = documents.select("doc_id", "text", code_of(F.col("lang"), names).alias("code")).where("code is not null and text is not null")
    counts = {r["code"]: r["count"] for r in docs.groupBy("code").count().collect()}
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, per_lang / n))]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    drawn = docs.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_003)) < share[F.col("code")] * 1_000_003)
    rows = drawn.select("code", F.substring("text", 1, CHARS_PER_DOC).alias("text")).limit(2 * per_lang * max(1, len(counts))).collect()
    return [(line, r["code"]) for r in rows for line in prose_lines(r["text"])[:LINES_PER_DOC] if prose.is_passage(line)]
