"""TF-IDF search over documents, all of it as DataFrame aggregates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import scoring
from .scoring import STOP_WORDS


def tokens_of(text: Column) -> Column:
    """Lower-case words of two or more of ``[a-z0-9_-]`` that are no stop words; null text gives no tokens."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_\s-]", " ")
    return F.filter(F.split(cleaned, r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n): occurrences of each term in each document, combined before the shuffle."""
    return docs.select(key, F.explode(tokens_of(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def idf(posted: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((N + 1) / (df + 1)) + 1 over all documents."""
    total = docs.agg(F.count("*").alias("total"))
    freq = posted.groupBy("term").agg(F.count("*").alias("df"))
    # One row of totals.
    return freq.join(F.broadcast(total)).select("term", "df", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weights(posted: DataFrame, idfs: DataFrame, key: str) -> DataFrame:
    """(key, term, w): term frequency against the most frequent term of the document, times idf."""
    top = posted.groupBy(key).agg(F.max("n").alias("top"))
    return posted.join(top, key).join(idfs, "term").select(key, "term", (F.col("n") / F.col("top") * F.col("idf")).alias("w"))


def search(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", limit: int = 10) -> DataFrame:
    """The ``limit`` best documents for the words of ``query`` by cosine of TF-IDF vectors; ties by key.

    Terms of the query that no document has keep the weight 1 in its norm.
    """
    posted = postings(docs, key, text)
    idfs = idf(posted, docs)
    counts = {t: query.count(t) for t in query}
    top = max(counts.values())
    spark = docs.sparkSession
    asked = spark.createDataFrame([(t, n / top) for t, n in counts.items()], "term string, tf double")
    q = asked.join(idfs, "term", "left").select("term", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("qw"))
    qnorm = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    w = weights(posted, idfs, key)
    # The query's terms are a handful of rows.
    scored = w.join(F.broadcast(q), "term", "left").groupBy(key).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("dot is not null")
    return scored.join(F.broadcast(qnorm)).select(key, F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero vector or arrays of different length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


#: Words up to this length are met by their parts; longer ones by their pairs of letters.
LONG_WORD = 40


def _inside_pairs(words: DataFrame, parts: DataFrame) -> DataFrame:
    """(word, part): every word of ``words`` with each of ``parts`` that it holds, by equality of keys: no pair of all words is made."""
    short = words.where(F.length("word") <= LONG_WORD)
    ends = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.transform(F.sequence(F.lit(2), F.length("word") - i + 1), lambda n: F.substring("word", i, n)))))
    by_part = short.select("word", ends.alias("part")).distinct().join(parts, "part")
    long = words.where(F.length("word") > LONG_WORD)
    letters = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))))
    by_letters = long.select("word", letters.alias("first")).join(parts.withColumn("first", F.substring("part", 1, 2)), "first").where(F.contains("word", "part"))
    return by_part.select("word", "part").unionByName(by_letters.select("word", "part"))


def _queries(queries: DataFrame) -> list[tuple[int, str]]:
    """The queries (query, text), which every task gets."""
    rows = queries.where("query is not null").select(F.col("query").cast("bigint"), "text").toArrow()
    return list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


def title_boosts(docs: DataFrame, queries: DataFrame, key: str = "doc_id", title: str = "title", places: int | None = None) -> DataFrame:
    """(query, key, boost) where it is above 0: 1 if the title holds the whole query, else the share of the query's words that hold a title's word or are held by one; rounded where ``places`` is given."""
    return scoring.boosts(docs, _queries(queries), key, title, places)


def hybrid(docs: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, asked: DataFrame | None = None, key: str = "doc_id", vector: str = "embedding", limit: int = 10, threshold: float = 0.1, only: Column | None = None) -> DataFrame:
    """(query, key, score): the ``limit`` best documents (key, title, content) for each query (query, text).

    The score is 0.7 of the lexical and 0.3 of the title's part; with
    ``vectors`` (key, vector) and ``asked`` (query, vector) 0.5, 0.2 and 0.3 of
    the cosine. Documents below ``threshold`` or without a score above 0, or for
    which ``only`` does not hold, are left out; ``only`` may name any column of
    ``docs``. Document frequencies are those of all documents. Scores are
    rounded to six places; ties go by key.
    """
    text = F.concat_ws(" ", "title", "content").alias("text")
    of_query = {}
    if vectors is not None:
        rows = asked.where(F.col("query").isNotNull() & F.col(vector).isNotNull()).select(F.col("query").cast("bigint"), F.col(vector).cast("array<double>")).toArrow()
        of_query = dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
    wanted = scoring.asked_of(_queries(queries), of_query)
    kept = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    texts, vocabulary = scoring.corpus(docs.select(key, "title", text, kept.alias("_kept")), key, {w for x in wanted for w in x.words}, F.size(tokens_of(F.col("title"))) > 0)
    texts = texts.where("_kept").select(key, "title", "text")
    shares = (0.7, 0.3, 0.0)
    if vectors is not None:
        shares, texts = (0.5, 0.2, 0.3), scoring.with_vectors(texts, vectors, key, vector, alone=only is None)
    return best(scoring.ranked(texts, wanted, vocabulary, key, limit, threshold, shares, titled=True), key, limit)


def with_fallback(found: DataFrame, near: DataFrame, key: str = "doc_id", limit: int = 10, least: float = 0.3) -> DataFrame:
    """``found`` filled up, where a query has fewer than ``limit`` hits, with rows of ``near`` whose cosine is above ``least``; then ranked anew."""
    found, near = cut(found), cut(near)
    few = near.select("query").distinct().join(found.groupBy("query").agg(F.count("*").alias("n")), "query", "left").where(F.coalesce("n", F.lit(0)) < limit).select("query")
    more = near.where(F.col("score") > least).join(few, "query", "left_semi").join(found.select("query", key), ["query", key], "left_anti")
    return best(found.unionByName(more), key, limit)


def suggest(idfs: DataFrame, partial: DataFrame, limit: int = 5) -> DataFrame:
    """(query, suggestion): for each partial query (query, text) the ``limit`` rarest terms that complete its last word, behind its other words; ties by term."""
    words = partial.select("query", tokens_of(F.col("text")).alias("words")).where("size(words) > 0")
    asked = words.select("query", F.try_element_at("words", F.lit(-1)).alias("last"), F.array_join(F.slice("words", 1, F.greatest(F.lit(0), F.size("words") - 1)), " ").alias("first"))
    # A term meets the words that it begins with by equality.
    starts = idfs.select("term", "idf", F.explode(F.transform(F.sequence(F.lit(2), F.length("term") - 1), lambda n: F.substring("term", 1, n))).alias("last"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("idf", 6)), "term"))
    found = asked.join(starts.where(F.length("term") > 2), "last").withColumn("rank", rank).where(F.col("rank") <= limit)
    return found.select("query", F.when(F.col("first") == "", F.col("term")).otherwise(F.concat_ws(" ", "first", "term")).alias("suggestion"))


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, first_doc, position): each term with where it stands first, by key and place; that order is the vocabulary's."""
    placed = docs.select(key, F.posexplode(tokens_of(F.col(text))).alias("position", "term"))
    first = placed.groupBy("term").agg(F.min(F.struct(F.col(key), F.col("position"))).alias("at"))
    return first.select("term", F.col(f"at.{key}").alias("first_doc"), F.col("at.position").alias("position"))


def highlights(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, positions, snippet): all places of the words, word by word, overlapping ones too, and the text around the first."""
    low = F.lower(text)

    def places(word: str) -> Column:
        """Where the word begins, from 1 on: the text is split before each of its places, so that the pieces' lengths add up to them."""
        pieces = F.split(low, "(?=" + re.sub(r"(\W)", r"\\\1", word) + ")")
        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))
        step = lambda acc, x: F.struct((acc["next"] + F.length(x)).alias("next"), F.when((acc["next"] > 1) | F.startswith(low, F.lit(word)), F.array_append(acc["at"], acc["next"])).otherwise(acc["at"]).alias("at"))
        return F.aggregate(pieces, start, step, lambda acc: acc["at"])

    held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    found = docs.where(held).select(key, text, F.concat(*[places(w) for w in words]).alias("at"))
    p = F.element_at("at", 1)
    start, end = F.greatest(F.lit(1), p - 40), F.least(F.length(text), p + 119)
    snippet = F.concat(F.when(p > 41, "...").otherwise(""), F.col(text).substr(start, end - start + 1), F.when(p + 119 < F.length(text), "...").otherwise(""))
    return found.select(key, F.array_join("at", ",").alias("positions"), snippet.alias("snippet"))


def client_search(pages: DataFrame, query: str, key: str = "doc_id", limit: int = 8) -> DataFrame:
    """(key, score) of the best pages (key, title, text, headings): 10 for the title, 1 for the text, 5 for each heading that holds the query; shorter queries than two letters find nothing."""
    if len(query) < 2:
        return pages.select(key, F.lit(0).cast("bigint").alias("score")).where("false")
    q = query.lower()
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False)).cast("bigint")
    headings = F.coalesce(F.size(F.filter("headings", lambda h: F.contains(F.lower(h), F.lit(q)))), F.lit(0))
    score = 10 * holds(F.col("title")) + holds(F.col("text")) + 5 * F.greatest(F.lit(0), headings).cast("bigint")
    return pages.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


#: Vectors of a block by ids: so many queries meet so many rows in one product.
QUERY_IDS, ROW_IDS = 51_200, 2_048


def _blocks(vectors: DataFrame, key: str, vector: str, ids: int, prefix: str) -> DataFrame:
    """(block, dim, keys, flat): the vectors of each range of ``ids`` keys and each length, one after another."""
    rows = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0)).groupBy(F.floor(F.col(key) / ids).alias(f"{prefix}block"), F.size(vector).alias("dim"))
    listed = rows.agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))).alias("l"))
    return listed.select("dim", F.col("l.k").alias(f"{prefix}keys"), F.flatten("l.v").alias(f"{prefix}flat"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, limit: int = 20) -> DataFrame:
    """(query, key, score): the ``limit`` rows nearest to every query by cosine, rounded to five places; ties by key.

    Blocks of queries meet blocks of rows in one matrix product each, which
    keeps ``limit`` rows a query; these are merged per query. Vectors of other
    lengths don't meet; a zero vector has the score 0. Null keys and vectors have no row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(m: np.ndarray) -> np.ndarray:
            norms = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                qk, rk = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("qkeys", "rkeys"))
                # One product of blocks.
                q, r = (unit(batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim)) for c in ("qflat", "rflat"))
                scores = np.round(q @ r.T, 5) + 0.0
                top = [np.lexsort((rk, -line))[:limit] for line in scores]
                n = min(limit, len(rk))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qk, n)), pa.array(rk[np.concatenate(top)]), pa.array(np.concatenate([s[t] for s, t in zip(scores, top, strict=True)]))], names=["query", key, "score"])

    pairs = _blocks(queries, key, vector, QUERY_IDS, "q").join(_blocks(vectors, key, vector, ROW_IDS, "r"), "dim")
    found = pairs.select("dim", "qkeys", "qflat", "rkeys", "rflat").mapInArrow(work, f"query bigint, {key} bigint, score double")
    return best(found, key, limit)


def best(scored: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` best rows of every ``query`` by score, ties by key."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", key, "score")


def related(docs: DataFrame, asked: Column, key: str = "doc_id", text: str = "text", limit: int = 10) -> DataFrame:
    """(query, key, score): for every document where ``asked`` holds, the ``limit`` best documents by cosine of TF-IDF vectors."""
    texts = docs.select(key, F.col(text).alias("text"))
    wanted = scoring.asked_of(_queries(texts.where(asked).select(F.col(key).alias("query"), "text")), {})
    texts, vocabulary = scoring.corpus(texts, key, {w for x in wanted for w in x.words})
    return best(scoring.ranked(texts, wanted, vocabulary, key, limit, 0.0, (1.0, 0.0, 0.0), titled=False), key, limit)


def reranked(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query, key, score): hits with a score by their rank alone: 1 for the first, going down in equal steps."""
    by = Window.partitionBy("query")
    place = F.row_number().over(by.orderBy(F.desc("score"), key)) - 1
    return found.select("query", key, F.round(1 - place / F.count("*").over(by), 6).alias("score"))
