"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame

from ..session import spread
from .stages import run_batches

#: Ranks of the tokenizer; a path that every executor can read.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level tokenizer splits a text before merging. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, key: str, text: str, more: dict[str, str] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, more..., tokens): the size of each whole text. Null texts have no row, empty ones 0. ``more`` maps columns to types."""
    more = more or {}
    work = lambda k, t, *rest: [(k, *rest, len(encoding(tokenizer).encode_ordinary(t)))]
    schema = ", ".join([f"{key} bigint", *(f"{c} {t}" for c, t in more.items()), "tokens bigint"])
    return run_batches(spread(docs.where(f"{text} is not null").select(key, text, *more)), work, schema)
