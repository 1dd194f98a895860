"""Language labels of documents and their segments by hyperdimensional profiles (problem 9).

Every letter has a random vector of +1 and -1. An n-gram of letters binds the
vectors of its letters, permuted by their place, into one (an elementwise
product); a text bundles those of its n-grams (a sum); a language's prototype
bundles the texts of a bounded sample of labelled documents, less the mean of
all prototypes. A text belongs to the prototype of largest cosine. As bundling
is a sum, the dot product of a text with a prototype is the sum of those of its
n-grams, which a task keeps once computed; the norm of a text's bundle is that
of nearly orthogonal n-grams. Lines are compared so; documents and segments
add up the letters of their lines.

Nulls: null and empty texts, and texts without prose, get no language. A null
or unknown label counts as missing. Repeated rows are each labelled. An empty
table gives no rows; without any labelled document nothing gets a language.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import labelled, prose
from .stages import run_blocks

DIMENSIONS = 4096
#: A line of fewer letters, or whose two best cosines are nearer than this, follows its neighbours.
LEAST_LETTERS, LEAST_GAP = 12, 0.02
SCHEMA = "doc_id bigint, label string, segment_no int, lang string, confidence double, letters bigint, segments int"


#: Which code points are letters; rarer planes hold none of the languages.
LETTER = np.array([chr(i).isalpha() for i in range(0x30000)])
#: Which code points are of Korean, Japanese or Chinese.
WIDE = np.array([bool(prose.CJK.match(chr(i))) for i in range(0x30000)])
#: Bound vectors made at once, n-grams and letters kept by a task.
STEP, MOST_GRAMS, MOST_LETTERS = 1024, 400_000, 8192
#: Characters of documents that are compared together.
BLOCK_CHARS = 1 << 17


def grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, n-gram, count) of the lower-case lines, and the letters of each line.

    An n-gram is a number of 21 bits a letter. Of lines with Korean, Japanese or
    Chinese also the single letters count, as these languages have short words.
    """
    chars = np.frombuffer((" " + " \n ".join(lines).lower() + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    end = chars == 10
    known = np.minimum(chars, len(LETTER) - 1)
    letter = LETTER[known]
    line = np.cumsum(end)
    letters = np.bincount(line[letter], minlength=len(lines))
    wide = np.bincount(line[WIDE[known]], minlength=len(lines)) > 0
    chars = np.where(letter | end, chars, 32)
    blank = chars == 32
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    chars, line, end = chars[keep], line[keep], end[keep]
    whole = ~(end[:-2] | end[1:-1] | end[2:])
    codes = [((chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:])[whole]]
    at = [line[:-2][whole]]
    single = wide[line] & ~end & (chars != 32)
    codes.append(chars[single])
    at.append(line[single])
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    pair, n = np.unique(np.concatenate(at) * max(1, len(code)) + place, return_counts=True)
    return pair // max(1, len(code)), code[pair % max(1, len(code))], n, letters


class Profiles:
    """Prototypes of the languages, and the dot products of n-grams with them."""

    def __init__(self, langs: list[str], prototypes: np.ndarray) -> None:
        self.langs, self.prototypes = langs, prototypes
        self._letters: dict[int, np.ndarray] = {}
        self._index: dict[int, int] = {}
        self._dots = np.zeros((1024, len(langs)), np.float32)

    def __reduce__(self) -> tuple:
        return _kept, (self.langs, self.prototypes)

    def letter(self, c: int) -> np.ndarray:
        v = self._letters.get(c)
        if v is None:
            if len(self._letters) > MOST_LETTERS:
                self._letters.clear()
            v = self._letters[c] = np.random.default_rng(c).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)
        return v

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams: their letters' vectors, each permuted by its place."""
        out = np.stack([self.letter(c) for c in (codes & 0x1FFFFF).tolist()])
        for place in (1, 2):
            before = (codes >> (21 * place)) & 0x1FFFFF
            some = np.flatnonzero(before)
            if len(some):
                out[some] *= np.roll(np.stack([self.letter(c) for c in before[some].tolist()]), place, axis=1)
        return out.astype(np.float32)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the n-grams in the table of dot products; new ones are added."""
        if len(self._index) > MOST_GRAMS:
            self._index.clear()
        index = self._index
        codes, back = np.unique(codes, return_inverse=True)
        new = [c for c in codes.tolist() if c not in index]
        for i in range(0, len(new), STEP):
            part = np.array(new[i : i + STEP], np.int64)
            first = len(index)
            while first + len(part) > len(self._dots):
                self._dots = np.concatenate([self._dots, np.zeros_like(self._dots)])
            self._dots[first : first + len(part)] = self.bound(part) @ self.prototypes.T
            index.update(zip(part.tolist(), range(first, first + len(part)), strict=True))
        return np.fromiter((index[c] for c in codes.tolist()), np.int64, len(codes))[back]

    def cosines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of each line with each prototype, and the letters of each line."""
        line, code, n, letters = grams(lines)
        total = np.zeros((len(lines), len(self.langs)), np.float64)
        norm = np.zeros(len(lines))
        if len(code):
            # The n-grams of a line stand together.
            at = np.flatnonzero(np.diff(line, prepend=-1))
            total[line[at]] = np.add.reduceat(self._dots_of(code) * n[:, None].astype(np.float32), at, axis=0)
            norm[line[at]] = np.add.reduceat(n.astype(np.float64) ** 2, at) * DIMENSIONS
        return total / np.sqrt(np.maximum(norm, 1.0))[:, None], letters

    def _dots_of(self, codes: np.ndarray) -> np.ndarray:
        at = self.places(codes)
        return self._dots[at]


_LAST: list[tuple[bytes, Profiles]] = []


def _kept(langs: list[str], prototypes: np.ndarray) -> Profiles:
    """The profiles that this worker already holds, where they are the same: a later task reuses their n-grams."""
    mark = prototypes.tobytes()
    if not _LAST or _LAST[0][0] != mark or _LAST[0][1].langs != langs:
        _LAST[:] = [(mark, Profiles(langs, prototypes))]
    return _LAST[0][1]


def _vectors(signs: np.ndarray) -> np.ndarray:
    return np.unpackbits(signs, axis=1).astype(np.float32) * 2 - 1


def fit(lines: list[tuple[str, str]]) -> Profiles:
    """Prototypes of labelled lines. Lines that the first prototypes call another language are labelled wrongly and left out of the second."""
    langs = sorted({c for _, c in lines})
    own = np.array([langs.index(c) for _, c in lines])
    line, code, n, _ = grams([t for t, _ in lines])
    codes, at = np.unique(code, return_inverse=True)
    empty = Profiles(langs, np.zeros((len(langs), DIMENSIONS), np.float32))
    signs = [np.packbits(empty.bound(codes[i : i + STEP]) > 0, axis=1) for i in range(0, len(codes), STEP)]
    norm = np.sqrt(np.maximum(np.bincount(line, weights=n.astype(np.float64) ** 2, minlength=len(lines)), 1.0))
    right = np.ones(len(lines), bool)
    for _ in range(2):
        used = right[line]
        sums = np.bincount(own[line[used]] * len(codes) + at[used], weights=n[used], minlength=len(langs) * len(codes)).reshape(len(langs), -1)
        w = np.sqrt(sums / np.maximum(sums.sum(axis=1, keepdims=True), 1)).astype(np.float32)
        p = np.zeros((len(langs), DIMENSIONS), np.float32)
        for i, b in enumerate(signs):
            p += w[:, i * STEP : i * STEP + len(b)] @ _vectors(b)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-6)
        p -= p.mean(axis=0)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-6)
        dots = np.concatenate([_vectors(b) @ p.T for b in signs])
        total = np.stack([np.bincount(line, weights=dots[at, k] * n, minlength=len(lines)) for k in range(len(langs))], axis=1)
        right = (total / norm[:, None]).argmax(axis=1) == own
    return Profiles(langs, p)


def lines_of(profiles: Profiles, text: str) -> list[tuple[str, int, float]]:
    """(language, letters, confidence) of the lines of prose of one text."""
    return lines_of_all(profiles, [text])[0]


def lines_of_all(profiles: Profiles, texts: list[str]) -> list[list[tuple[str, int, float]]]:
    """(language, letters, confidence) of each text's lines of prose; uncertain lines follow the line before, else the one after."""
    lines = [labelled.prose_lines(t) for t in texts]
    flat = [x for own in lines for x in own]
    if not flat:
        return [[] for _ in texts]
    every, letters = profiles.cosines(flat)
    best = every.argmax(axis=1)
    top = every.max(axis=1)
    p = np.exp((every - top[:, None]) * 20)
    sure = (1 / p.sum(axis=1)).tolist()
    every[np.arange(len(best)), best] = -np.inf
    gaps = (top - every.max(axis=1)).tolist()
    best, letters = best.tolist(), letters.tolist()
    out, at = [], 0
    for own in lines:
        found = []
        for i, line in enumerate(own, at):
            least = LEAST_LETTERS if line.isascii() or not prose.CJK.search(line) else 5
            found.append((profiles.langs[best[i]], letters[i], sure[i], gaps[i] >= LEAST_GAP and letters[i] >= least and prose.is_passage(line)))
        out.append(_settled(found))
        at += len(own)
    return out


def _settled(lines: list[tuple[str, int, float, bool]]) -> list[tuple[str, int, float]]:
    """Lines of one text after uncertain ones took their neighbour's language."""
    last = next((lang for lang, _, _, clear in lines if clear), None)
    if last is None:
        # Nothing is certain: the longest line speaks for all.
        return [(max(lines, key=lambda x: x[1])[0], sum(x[1] for x in lines), min(x[2] for x in lines))] if lines else []
    out = []
    for lang, n, p, clear in lines:
        last = lang if clear else last
        out.append((last, n, p))
    return out


def segments_of(lines: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
    """(language, letters, confidence) of the document, then of its longest runs of one language."""
    if not lines:
        return []
    total: dict[str, int] = {}
    runs: list[list] = []
    for lang, n, p in lines:
        total[lang] = total.get(lang, 0) + n
        if runs and runs[-1][0] == lang:
            runs[-1][1] += n
            runs[-1][2] += n * p
        else:
            runs.append([lang, n, n * p])
    main = max(total, key=lambda k: (total[k], k))
    letters = sum(total.values())
    sure = sum(p * n for lang, n, p in lines if lang == main) / max(1, total[main])
    return [(main, letters, sure * total[main] / max(1, letters))] + [(lang, n, p / max(1, n)) for lang, n, p in runs]


def labels(documents: DataFrame, lang_codes: DataFrame) -> DataFrame:
    """(doc_id, label, segment_no, lang, confidence, letters, segments): segment 0 is the document; ``label`` is its own label's code."""
    spark = documents.sparkSession
    lines = labelled.sample(documents, lang_codes)
    if not lines:
        return spark.createDataFrame([], SCHEMA)
    profiles = fit(lines)

    def block(rows: list[tuple]) -> list[tuple]:
        return [
            (doc_id, label, i, lang, p, n, len(found) - 1)
            for (doc_id, label, _), lines in zip(rows, lines_of_all(profiles, [r[2] for r in rows]), strict=True)
            for found in [segments_of(lines)]
            for i, (lang, n, p) in enumerate(found)
        ]

    def work(rows: list[tuple]) -> list[tuple]:
        out, part, chars = [], [], 0
        for row in rows:
            part.append(row)
            chars += len(row[2])
            if chars >= BLOCK_CHARS:
                out += block(part)
                part, chars = [], 0
        return out + block(part)

    code = labelled.code_of(F.col("lang"), labelled.names_of(lang_codes))
    return run_blocks(spread(documents.where("text is not null").select("doc_id", code.alias("label"), "text")), work, SCHEMA)


def found(documents: DataFrame, lang_codes: DataFrame) -> DataFrame:
    """(doc_id, segment_no, lang): main languages of documents without the right label, and the segments of mixed ones."""
    rows = labels(documents, lang_codes)
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return rows.where(((F.col("segment_no") == 0) & wrong) | ((F.col("segment_no") > 0) & (F.col("segments") > 1))).select("doc_id", "segment_no", "lang")
