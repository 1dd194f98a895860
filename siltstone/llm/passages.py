"""Natural language inside code (problem 2).

Files are lexed in chunks, whose true states are prefix products of the chunks'
state maps (:mod:`siltstone.llm.lexing`), huge files by several tasks
(:mod:`siltstone.llm.stages`). Comments (neighbouring lines are one),
docstrings and literals (joined ones are one, escapes are read) become
passages. Each sentence of a passage is labelled by multinomial logistic
regression on hashed n-grams, fitted on a bounded sample of the labelled
documents (:mod:`siltstone.llm.labelled`).

Nulls: rows without content or description, and files of an unknown language,
have no passages. Empty texts have none. Repeated rows each count. An empty
table gives no rows; without any labelled document no passage has a language.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import labelled, lexing, ngram_model, prose, secrets
from .stages import lexed_files, run_batches

#: A sentence's language holds from this probability on.
LEAST_PROBABILITY = 0.5
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\s/\s|\n\s*\n|\s\|\s")
JOINED = re.compile(r"[\s+.&\\(),]*")
#: Runs of letters.
LETTERS = re.compile(r"[^\W\d_]+")
SCHEMA = "record_id bigint, repo string, record_letters int, passage_no int, lang string, probability double, letters int, text string"


def texts_of(lang: str, text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The passages of a file, as texts without marks and escapes."""
    out: list[str] = []
    i, n = 0, len(spans)
    while i < n:
        kind, a, b = spans[i]
        j = i + 1
        if kind == "l":
            while j < n and spans[j][0] == "l" and (mid := text[b : spans[j][1]]).isspace() and mid.count("\n") == 1:
                b = spans[j][2]
                j += 1
            out.append(prose.comment_text(text[a:b]))
        elif kind == "b":
            out.append(prose.comment_text(text[a:b]))
        elif kind in "st":
            raw = []
            while True:
                p, q = spans[j - 1][1:]
                body = re.sub(r"^[A-Za-z]{0,2}(\"\"\"|'''|[\"'`])|(\"\"\"|'''|[\"'`])$", "", text[p:q])
                raw.append(body if re.match(r"[bB]?[rR]", text[p : p + 2]) or text[p] == "`" and lang == "go" else secrets.unescape(body))
                if j >= n or spans[j][0] not in "st":
                    break
                mid = text[q : spans[j][1]]
                if not JOINED.fullmatch(mid) or "," in mid or lang in ("json", "yaml", "graphql") or not ("+" in mid or "." in mid or lang in ("c", "py")):
                    break
                j += 1
            out.append("".join(raw))
        elif kind == "h":
            out.append(re.sub(r"<[^>]*>", " ", text[a:b]))
        i = j
    if lang == "yaml":
        quoted = {(a, b) for k, a, b in spans if k == "s"}
        out += [text[a:b] for _, a, b, _ in secrets.config_values("yaml", text) if (a - 1, b + 1) not in quoted and " " in text[a:b] or prose.CJK.search(text[a:b])]
    return out


def label(model: ngram_model.Model, passage: str) -> list[tuple[str, int, float]]:
    """(language, letters, probability) of the sentences of a passage; sentences too short to judge join the one before."""
    plain = labelled.without_noise(prose.without_tags(passage))
    if not prose.is_passage(plain):
        return []
    parts: list[str] = []
    for s in SENTENCE.split(" ".join(plain.split("\n"))):
        if s.strip():
            if parts and not prose.is_passage(s):
                parts[-1] += " " + s
            else:
                parts.append(s)
    if len(parts) > 1 and not prose.is_passage(parts[0]):
        parts[:2] = [" ".join(parts[:2])]
    found = []
    for s in parts:
        lang, p = model.best(s)
        if p >= LEAST_PROBABILITY and prose.is_passage(s):
            found.append((lang, sum(c.isalpha() for c in s), p))
    return found


#: Short passages whose labels a task keeps; descriptions come again with every snapshot.
KEPT, KEPT_CHARS = 50_000, 1000


def languages(found: list[tuple[str, int, float]]) -> list[tuple[str, float, int]]:
    """(language, probability, letters) of a passage out of its sentences; the probability is their mean by letters."""
    sums: dict[str, tuple[int, float]] = {}
    for lang, n, p in found:
        letters, weight = sums.get(lang, (0, 0.0))
        sums[lang] = letters + n, weight + n * p
    return [(lang, w / max(1, n), n) for lang, (n, w) in sorted(sums.items())]


def _worker(model: ngram_model.Model, with_text: bool) -> Callable:
    kept: dict[str, list[tuple[str, float, int]]] = {}

    def labels(passage: str) -> list[tuple[str, float, int]]:
        found = kept.get(passage)
        if found is None:
            found = languages(label(model, passage))
            if len(passage) <= KEPT_CHARS:
                if len(kept) >= KEPT:
                    kept.clear()
                kept[passage] = found
        return found

    def rows(key: int, repo: str | None, whole: str, texts: list[str]) -> list[tuple]:
        found = [(no, lang, p, n, t if with_text else None) for no, t in enumerate(texts) for lang, p, n in labels(t)]
        letters = sum(map(len, LETTERS.findall(whole))) if found else 0
        return [(key, repo, letters, *f) for f in found]

    return rows


def model_of(documents: DataFrame, lang_codes: DataFrame) -> ngram_model.Model | None:
    lines = labelled.sample(documents, lang_codes)
    return ngram_model.fit(lines) if lines else None


def in_files(source_files: DataFrame, model: ngram_model.Model, with_text: bool = True) -> DataFrame:
    """(record_id, repo, record_letters, passage_no, lang, probability, letters, text): each passage of a file, once per language in it.

    ``record_letters`` are all letters of the file, code included; ``passage_no`` counts its comments and
    literals from 0, those that are no passage too.
    """
    rows = _worker(model, with_text)

    def work(file_id: int, repo: str, x: lexing.Lexed) -> list[tuple]:
        return rows(file_id, repo, x.text, texts_of(x.lang, x.text, x.spans))

    return lexed_files(source_files, ["file_id", "repo"], work, SCHEMA)


def in_endpoints(endpoints: DataFrame, model: ngram_model.Model, with_text: bool = True) -> DataFrame:
    """The same for the descriptions of endpoints."""
    rows = _worker(model, with_text)
    described = spread(endpoints.where("description is not null").select("row_id", "project", "description"))
    return run_batches(described, lambda i, repo, t: rows(i, repo, t, [t]), SCHEMA)


def passages(source_files: DataFrame, endpoints: DataFrame, documents: DataFrame, lang_codes: DataFrame, with_text: bool = True) -> DataFrame:
    """(record, record_id, repo, record_letters, passage_no, lang, probability, letters, text) of files and endpoints; ``text`` null without ``with_text``."""
    model = model_of(documents, lang_codes)
    if model is None:
        return source_files.sparkSession.createDataFrame([], "record string, " + SCHEMA)
    files, described = in_files(source_files, model, with_text), in_endpoints(endpoints, model, with_text)
    return files.select(F.lit("file").alias("record"), "*").unionByName(described.select(F.lit("endpoint").alias("record"), "*"))


def found(passages: DataFrame) -> DataFrame:
    """(record, record_id, lang) of every language other than English that has a passage."""
    return passages.where("lang <> 'en'").select("record", "record_id", "lang").distinct()


def record_shares(passages: DataFrame) -> DataFrame:
    """(record, record_id, repo, lang, passages, letters, share): letters of each language, and their share of all letters of the record."""
    per = passages.groupBy("record", "record_id", "repo", "lang").agg(F.count("*").alias("passages"), F.sum("letters").alias("letters"), F.max("record_letters").alias("all"))
    return per.select("record", "record_id", "repo", "lang", "passages", "letters", F.least(F.lit(1.0), F.col("letters") / F.greatest(F.lit(1), "all")).alias("share"))
