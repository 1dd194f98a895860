"""Multinomial logistic regression on hashed character n-grams."""

from __future__ import annotations

import numpy as np

BITS = 15
#: Multipliers of the hash of n-grams of one, two and three characters.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def features(text: str) -> np.ndarray:
    """Hashed n-grams of one to three characters of the lower-case text, blanks at its ends."""
    chars = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h, out = chars * FACTORS[0], []
        out.append(h[1:-1])
        for n in (1, 2):
            if len(chars) > n:
                h = (h[: len(chars) - n] ^ (h[: len(chars) - n] >> np.uint64(29))) * FACTORS[n] + chars[n:] * FACTORS[0]
                out.append(h)
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    """Weights of every hashed n-gram for each language."""

    def __init__(self, langs: list[str], weights: np.ndarray) -> None:
        self.langs, self.weights = langs, weights

    def probabilities(self, text: str) -> np.ndarray:
        f = features(text)
        z = self.weights[f].sum(axis=0) * (4.0 / np.sqrt(max(1, len(f))))
        e = np.exp(z - z.max())
        return e / e.sum()

    def best(self, text: str) -> tuple[str, float]:
        p = self.probabilities(text)
        i = int(p.argmax())
        return self.langs[i], float(p[i])


def _fit(rows: list[tuple[np.ndarray, int]], k: int, epochs: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    w, g2 = np.zeros((1 << BITS, k), np.float32), np.full((1 << BITS, 1), 1e-3, np.float32)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, y = rows[i]
            scale = 4.0 / np.sqrt(max(1, len(f)))
            z = w[f].sum(axis=0) * scale
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            u = np.unique(f)
            g2[u, 0] += float(p @ p) * scale * scale
            w[u] -= (0.1 * scale / np.sqrt(g2[u])) * p
    return w


def fit(lines: list[tuple[str, str]], epochs: int = 3) -> Model:
    """Fit on labelled lines. Lines that a fit on the other half calls another language are labelled wrongly and left out."""
    langs = sorted({c for _, c in lines})
    rows = [(features(t), langs.index(c)) for t, c in lines]
    halves = rows[::2], rows[1::2]
    kept = []
    for own, other in (halves, halves[::-1]):
        w = _fit(other, len(langs), 1)
        kept += [(f, y) for f, y in own if int(w[f].sum(axis=0).argmax()) == y]
    return Model(langs, _fit(kept or rows, len(langs), epochs))
