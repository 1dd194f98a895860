"""Scores of many queries for all documents, by blocks: no row is made for a pair that isn't returned.

The documents are read twice, without a shuffle of their words: once for the
document frequencies, once for the scores, where a task holds its documents
against all queries in products of blocks and keeps the best of each query.
The queries and the words that more than one document has go to every task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_side, spread

#: Words that say nothing. Fixed values.
STOP_WORDS = tuple(
    "a an the is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during before after above below between out off over "
    "under again further then once here there when where why how all each every both few more most other some such no nor not only own same so than too very just because but and or if while about up this that these those "
    "it its he she they we you me him her us them my your his our their what which".split()
)
STOP = frozenset(STOP_WORDS)
WORD = re.compile(r"[a-z0-9_-]+")
#: Documents and queries of a block, and rows of an Arrow batch of results.
ROWS, COLUMNS, BATCH = 1_024, 2_048, 1 << 19
#: A word whose pairs are more than this share of a block's pairs goes by a product of matrices.
DENSE = 0.005
#: Words after which a task hands on what it has counted.
COUNTED = 1 << 20
#: Repeated keys that go to every task.
MOST_KEYS = 1 << 20


def words_of(text: str | None) -> Counter:
    """Occurrences of the words of a text, those of ``search.tokens_of``."""
    counts = Counter(WORD.findall(text.lower())) if text else Counter()
    for t in [t for t in counts if len(t) < 2 or t in STOP]:
        del counts[t]
    return counts


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    return np.floor(x * 10**places + 0.5) / 10**places


def frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): in how many rows each word is; the null term has the number of all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        rows = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([None, *found], pa.string()), pa.array([rows, *found.values()], pa.int64())], names=["term", "n"])
        for batch in batches:
            rows += batch.num_rows
            for t in batch.column(0).to_pylist():
                found.update(words_of(t).keys())
            if len(found) > COUNTED:
                yield flush()
                found, rows = Counter(), 0
        yield flush()

    return spread(texts.select(text)).mapInArrow(work, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def corpus(texts: DataFrame, key: str, asked: set[str], worded: Column | None = None) -> tuple[DataFrame, Vocabulary]:
    """``texts`` (key, text, ...), where rows of one key all have its texts together, and the vocabulary: every key is one document, every row counts in their number.

    Only rows of keys that repeat are gathered; the others stay where they are
    read. Rows without a key are one document of the vocabulary, and left out.
    A gathered document has a row for each title that is ``worded``, or one if
    none is.
    """
    if texts.groupBy(key).count().where("count > 1").isEmpty():
        return texts, Vocabulary(frequencies(texts), asked)
    named = texts.where(F.col(key).isNotNull())
    again = cut(named.groupBy(key).count().where("count > 1").select(key))
    # Keys only, and at most MOST_KEYS of them; where more repeat, all rows are gathered.
    few = again.count() <= MOST_KEYS
    repeated = named.join(F.broadcast(again), key, "left_semi") if few else named
    titled, kept = "title" in texts.columns, "_kept" in texts.columns
    more = [F.collect_list(F.when(F.lit(True) if worded is None else worded, F.col("title"))).alias("titles")] * titled + [F.max("_kept").alias("_kept")] * kept
    whole = repeated.groupBy(key).agg(F.concat_ws(" ", F.collect_list("text")).alias("text"), *more)
    each = (whole.select("*", F.explode_outer("titles").alias("title")) if titled else whole).select(*texts.columns)
    found = whole.select("text")
    if few:
        once = spread(named.join(F.broadcast(again), key, "left_anti").select(*texts.columns))
        each, found = once.unionByName(each), once.select("text").unionByName(found)
    unnamed = frequencies(texts.where(F.col(key).isNull())).where("term is not null").select("term", F.lit(1).cast("bigint").alias("df"))
    freq = frequencies(found).unionByName(unnamed).groupBy("term").agg(F.sum("df").alias("df"))
    return each, Vocabulary(freq, asked, texts.count())


class Terms:
    """Weights of the queries of a block by word."""

    def __init__(self, queries: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, n: int) -> None:
        order = np.lexsort((queries, terms))
        self.queries, self.weights, self.n = queries[order], weights[order], n
        self.ptr = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.counts = np.diff(self.ptr)

    def product(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """(n, queries): for each row and query the sum of the products of their weights of a word; a row has a word once."""
        used = self.counts[terms] > 0
        rows, terms, weights = rows[used], terms[used], weights[used]
        many = np.flatnonzero(np.bincount(terms, minlength=len(self.counts)) * self.counts > DENSE * n * self.n)
        out = np.zeros((n, self.n))
        if len(many):
            place = np.full(len(self.counts), -1)
            place[many] = np.arange(len(many))
            at = place[terms]
            rest = at < 0
            left, right = np.zeros((n, len(many))), np.zeros((len(many), self.n))
            left[rows[~rest], at[~rest]] = weights[~rest]
            for i, t in enumerate(many):
                own = slice(self.ptr[t], self.ptr[t + 1])
                right[i, self.queries[own]] = self.weights[own]
            out = left @ right
            rows, terms, weights = rows[rest], terms[rest], weights[rest]
        if len(terms):
            held = self.counts[terms]
            index = _ranges(self.ptr[terms], held)
            flat = np.repeat(rows * self.n, held) + self.queries[index]
            out += np.bincount(flat, np.repeat(weights, held) * self.weights[index], minlength=n * self.n).reshape(n, self.n)
        return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _blocks(lists: list[dict[int, float]], n_terms: int) -> list[Terms]:
    """The queries' weights by word, in blocks of ``COLUMNS`` queries."""
    out = []
    for a in range(0, len(lists), COLUMNS):
        part = lists[a : a + COLUMNS]
        flat = [(i, t, w) for i, x in enumerate(part) for t, w in x.items()]
        q, t, w = zip(*flat, strict=True) if flat else ((), (), ())
        out.append(Terms(np.array(q, np.int64), np.array(t, np.int64), np.array(w, float), n_terms, len(part)))
    return out


class Top:
    """The best rows so far of the queries of a block: by rounded score, ties by key."""

    def __init__(self, n: int, limit: int, least: float, places: int) -> None:
        self.limit, self.least, self.places = limit, least, places
        self.floor = np.full(n, least)
        self.queries, self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """Take in the scores (rows, queries) of the rows ``keys``; what is not above 0 is no hit."""
        margin = 10.0**-self.places  # scores that far apart are never rounded to the same
        hit = (scores >= self.floor - margin) & (scores > 0)
        if len(keys) > self.limit and np.count_nonzero(hit) > 8 * self.limit * len(self.floor):
            at = len(keys) - self.limit
            hit &= scores >= np.partition(scores, at, axis=0)[at] - margin
        rows, queries = np.nonzero(hit)
        s = rounded(scores[rows, queries], self.places)
        kept = s >= self.least
        if not kept.any():
            return
        q, s, k = (np.concatenate([a, b[kept]]) for a, b in ((self.queries, queries), (self.scores, s), (self.keys, keys[rows])))
        order = np.lexsort((k, -s, q))
        q, s, k = q[order], s[order], k[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.floor[q[rank == self.limit - 1]] = s[rank == self.limit - 1]
        self.queries, self.scores, self.keys = (x[rank < self.limit] for x in (q, s, k))


class Titles:
    """The words that queries have, and which of them a title's word holds or is held by."""

    def __init__(self, asked: list[str]) -> None:
        self.asked, self.ids = asked, {w: i for i, w in enumerate(asked)}
        self.lengths = sorted({len(w) for w in asked})
        self.joined = "\n".join(asked)
        self.starts = [0]
        for w in asked:
            self.starts.append(self.starts[-1] + len(w) + 1)
        self.met: dict[str, list[int]] = {}

    def of_word(self, word: str) -> list[int]:
        if word not in self.met:
            found = {i for n in self.lengths if n <= len(word) for a in range(len(word) - n + 1) if (i := self.ids.get(word[a : a + n])) is not None}
            at = self.joined.find(word)
            while at >= 0:
                i = bisect_right(self.starts, at) - 1
                found.add(i)
                at = self.joined.find(word, self.starts[i + 1])
            if len(self.met) > COUNTED:
                self.met.clear()
            self.met[word] = sorted(found)
        return self.met[word]

    def of_title(self, title: str | None) -> list[int] | None:
        """Words of the queries that the title meets; None if it has no words."""
        words = words_of(title)
        return sorted({i for w in words for i in self.of_word(w)}) if words else None


def odd(words: Counter) -> bool:
    """Whether a title may hold the whole query and yet not meet each of its words: one is a part of a word that says nothing."""
    return any(w in s for w in words for s in STOP)


def _title_parts(queries: list[tuple[str | None, Counter]]) -> tuple[list[str], list[dict[int, float]], np.ndarray, list[tuple[int, str]]]:
    """Of the queries (text, words): all their words, how often each has which, how many each has, and those to look for as a whole."""
    asked = sorted({w for _, words in queries for w in words})
    ids = {w: i for i, w in enumerate(asked)}
    lists = [{ids[w]: float(n) for w, n in words.items()} for _, words in queries]
    whole = [(i, text.lower()) for i, (text, words) in enumerate(queries) if odd(words)]
    return asked, lists, np.array([max(1, words.total()) for _, words in queries], float), whole


def _met(found: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(found)), [len(x or ()) for x in found])
    ids = np.array([i for x in found for i in x or ()], np.int64)
    return rows, ids, np.ones(len(ids))


def _share(block: Terms, total: np.ndarray, whole: list[tuple[int, str]], met: tuple, titles: list[str | None], found: list[list[int] | None]) -> np.ndarray:
    """(titles, queries): the title's part of the score, by counts, so that equal shares are equal numbers."""
    share = block.product(*met, len(titles)) / total
    for q, text in whole:
        for i, title in enumerate(titles):
            if found[i] is not None and text in title.lower():
                share[i, q] = 1.0
    return share


def boosts(titles: DataFrame, queries: list[tuple[int, str]], key: str, title: str, places: int | None = None) -> DataFrame:
    """(query, key, boost) of all pairs above 0, rounded where ``places`` is given."""
    of_text: dict[str, list[int]] = defaultdict(list)
    for q, text in queries:
        if text and words_of(text):
            of_text[text].append(q)
    texts = [(t, words_of(t)) for t in of_text]
    asked, lists, total, whole = _title_parts(texts)
    ids = [np.array(x, np.int64) for x in of_text.values()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meets, blocks = Titles(asked), _blocks(lists, len(asked))
        for batch in batches:
            keys, all_titles = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).dictionary_encode()
            # Equal titles of a batch are scored once.
            which, names = all_titles.indices.to_numpy(zero_copy_only=False), all_titles.dictionary.to_pylist()
            order = np.argsort(which, kind="stable")
            keys, which = keys[order], which[order]
            for a in range(0, len(names), ROWS):
                part = names[a : a + ROWS]
                found = [meets.of_title(t) for t in part]
                met = _met(found)
                rows_of = [np.searchsorted(which, a + i) for i in range(len(part) + 1)]
                for b, block in enumerate(blocks):
                    c = b * COLUMNS
                    share = _share(block, total[c : c + block.n], [(q - c, t) for q, t in whole if c <= q < c + block.n], met, part, found)
                    yield from _pairs(share, ids[c : c + block.n], [keys[x:y] for x, y in zip(rows_of, rows_of[1:], strict=False)])

    def _pairs(share: np.ndarray, of_column: list[np.ndarray], of_row: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Each pair above 0 of a row and a column, for all keys of the row and all queries of the column."""
        rows, columns = np.nonzero(share > 0)
        n_rows, n_columns = np.array([len(x) for x in of_row]), np.array([len(x) for x in of_column])
        n = n_rows[rows] * n_columns[columns]
        flat_keys, flat_queries = np.concatenate(of_row), np.concatenate(of_column)
        key_at, query_at = np.cumsum(n_rows) - n_rows, np.cumsum(n_columns) - n_columns
        values = share[rows, columns] if places is None else rounded(share[rows, columns], places)
        upto = np.cumsum(n)
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BATCH)))
            r, c, m = rows[a:b], columns[a:b], n[a:b]
            inside = _ranges(np.zeros(b - a, np.int64), m)
            wide = np.repeat(n_columns[c], m)
            k = flat_keys[np.repeat(key_at[r], m) + inside // wide]
            q = flat_queries[np.repeat(query_at[c], m) + inside % wide]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(k), pa.array(np.repeat(values[a:b], m))], names=["query", key, "boost"])
            a = b

    rows = titles.select(F.col(key).cast("bigint").alias(key), title).where(F.col(key).isNotNull() & F.col(title).isNotNull())
    return spread(rows).mapInArrow(work, f"query bigint, {key} bigint, boost double")


class Asked:
    """A query as it is scored, for all ids that ask the same."""

    def __init__(self, text: str | None, words: Counter, vector: list[float] | None) -> None:
        self.text, self.words, self.vector, self.ids = text, words, vector, []


def asked_of(rows: list[tuple[int, str | None]], vectors: dict[int, list[float]]) -> list[Asked]:
    """The queries (id, text), equal ones together; an id with several texts has the words of all, and without vectors no part for a text without words beside others."""
    texts = defaultdict(list)
    for q, text in rows:
        texts[q].append(text)
    for q in vectors:
        texts.setdefault(q, [None])
    out: dict[tuple, Asked] = {}
    for q, own in texts.items():
        if len(own) > 1 and not vectors:
            own = [t for t in own if words_of(t)] or own
        for text in own:
            v = vectors.get(q)
            x = out.setdefault((text, q if len(own) > 1 or v is not None else None), Asked(text, sum((words_of(t) for t in own), Counter()), v))
            if x.words or v is not None:
                x.ids.append(q)
    return [x for x in out.values() if x.ids]


class Vocabulary:
    """Weights of words: those of more than one document, and of the queries' words."""

    def __init__(self, freq: DataFrame, asked: set[str], n: int | None = None) -> None:
        spark = freq.sparkSession
        freq = cut(freq)
        self.n = n if n is not None else freq.where("term is null").agg(F.sum("df")).collect()[0][0] or 0
        many = freq.where("term is not null and df > 1").toArrow()
        terms, counts = many.column("term").to_pylist(), many.column("df").to_pylist()
        once = freq.where("df = 1").join(spark.createDataFrame([(t,) for t in asked], "term string"), "term").select("term").toArrow().column("term").to_pylist()
        self.terms = terms + once
        df = np.array(counts + [1] * len(once), float)
        self.idf = np.log((self.n + 1) / (df + 1)) + 1
        self.once = float(np.log((self.n + 1) / 2) + 1)
        self.ids = {t: i for i, t in enumerate(self.terms)}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "ids"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"ids": {t: i for i, t in enumerate(state["terms"])}}

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, weight) of the texts' known words, and each text's norm."""
        ids: list[int] = []
        counts: list[int] = []
        sizes, tops, others = [], [], []
        get = self.ids.get
        for text in texts:
            words = words_of(text)
            own = [(i, n) for t, n in words.items() if (i := get(t)) is not None]
            ids += [i for i, _ in own]
            counts += [n for _, n in own]
            sizes.append(len(own))
            tops.append(max(words.values(), default=1))
            others.append(sum(n * n for t, n in words.items() if t not in self.ids) if len(own) < len(words) else 0)
        row = np.repeat(np.arange(len(texts)), sizes)
        term = np.array(ids, np.int64)
        top = np.array(tops, float)
        w = np.array(counts, float) / top[row] * self.idf[term]
        norm = np.sqrt(np.bincount(row, w * w, minlength=len(texts)) + np.array(others, float) * (self.once / top) ** 2)
        return row, term, w, norm


def _unit(vectors: list[list[float] | None], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors of that length, and these at length 1; zero vectors stay."""
    at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
    m = np.array([vectors[i] for i in at], float).reshape(-1, dim)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.array(at, np.int64), np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def ranked(texts: DataFrame, asked: list[Asked], vocabulary: Vocabulary, key: str, limit: int, least: float, shares: tuple[float, float, float], titled: bool, places: int = 6) -> DataFrame:
    """(query, key, score): for each task the ``limit`` best of its rows for each query.

    ``texts`` has key, text and, where ``titled``, title; with a third share
    above 0 also ``_dv``, a vector. The score is the sum of ``shares`` times the
    cosine of the words, the title's part and the cosine of the vectors.
    """
    voc, n = vocabulary, len(vocabulary.terms)
    lists, qnorms = [], []
    for x in asked:
        top = max(x.words.values(), default=1)
        known = {voc.ids[t]: c / top * float(voc.idf[voc.ids[t]]) for t, c in x.words.items() if t in voc.ids}
        lists.append(known)
        qnorms.append(sum(w * w for w in known.values()) + sum((c / top) ** 2 for t, c in x.words.items() if t not in voc.ids))
    qnorm = np.sqrt(np.maximum(np.array(qnorms, float), 1e-300))
    parts = _title_parts([(x.text, words_of(x.text)) for x in asked]) if titled else None
    ids = [x.ids for x in asked]
    asked_vectors = [x.vector for x in asked]
    by_words, by_title, by_vector = shares
    columns = [key, "text", *["title"] * titled, *["_dv"] * (by_vector > 0)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(lists, n)
        tops = [Top(b.n, limit, least, places) for b in blocks]
        if titled:
            asked_words, counts, total, whole = parts
            meets, title_blocks = Titles(asked_words), _blocks(counts, len(asked_words))
        dims = {len(v) for v in asked_vectors if v}
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                m = part.num_rows
                keys = part.column(0).to_numpy(zero_copy_only=False)
                row, term, w, norm = voc.rows(part.column(1).to_pylist())
                w = w / norm[row]
                if titled:
                    titles = part.column(2).to_pylist()
                    found = [meets.of_title(t) for t in titles]
                    met = _met(found)
                vectors = part.column(len(columns) - 1).to_pylist() if dims else []
                own = {d: _unit(vectors, d) for d in dims}
                for b, block in enumerate(blocks):
                    c = b * COLUMNS
                    scores = block.product(row, term, w, m) / qnorm[c : c + block.n]
                    if by_words != 1:
                        scores *= by_words
                    if titled:
                        scores += by_title * _share(title_blocks[b], total[c : c + block.n], [(q - c, t) for q, t in whole if c <= q < c + block.n], met, titles, found)
                    for d, (at, v) in own.items():
                        of_query, qv = _unit(asked_vectors[c : c + block.n], d)
                        if len(at) and len(of_query):
                            scores[np.ix_(at, of_query)] += by_vector * (v @ qv.T)
                    tops[b].add(scores, keys)
        for b, top in enumerate(tops):
            lens = np.array([len(x) for x in ids[b * COLUMNS : b * COLUMNS + COLUMNS]], np.int64)
            flat = np.array([q for x in ids[b * COLUMNS : b * COLUMNS + COLUMNS] for q in x], np.int64)
            times = lens[top.queries]
            q = flat[_ranges((np.cumsum(lens) - lens)[top.queries], times)]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.repeat(top.keys, times)), pa.array(np.repeat(top.scores, times))], names=["query", key, "score"])

    rows = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), *columns[1:])
    return spread(rows).mapInArrow(work, f"query bigint, {key} bigint, score double")


def with_vectors(texts: DataFrame, vectors: DataFrame, key: str, vector: str, alone: bool) -> DataFrame:
    """``texts`` (key, title, text) with ``_dv``; with ``alone`` also the vectors of no text."""
    own = vectors.where(F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("_dv"))
    both = texts.join(small_side(own), key, "left")
    if not alone:
        return both
    none = F.lit(None).cast("string")
    rest = own.join(texts.select(key), key, "left_anti").select(key, none.alias("title"), none.alias("text"), "_dv")
    return both.select(key, "title", "text", "_dv").unionByName(rest)
