"""Lengths of texts in tokens of a public tokenizer, given as a file of byte-pair ranks."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.session import RESERVED, ship, spread

# Fixed value: how the tokenizer's files cut texts before pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT = os.environ.get("VERIDRAFT_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


#: A single space between two other characters: a token never reaches across its left side.
_GAP = re.compile(r"(?<=\S) (?=\S)")


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(self) < 200_000:
            self[piece] = n
        return n


class Counter:
    """Counts tokens. The pattern never joins a space with what stands before it if that is no space,
    so pieces between single spaces are counted one by one and remembered."""

    def __init__(self, path: str = DEFAULT):
        self.ranks = Path(path).read_bytes()  # about a megabyte, fixed by the vocabulary
        self._pieces: _Pieces | None = None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "_pieces": None}

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self._pieces is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self._pieces = _Pieces(tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
        known = self._pieces
        first, *rest = _GAP.split(text)
        return known[first] + sum([known[" " + p] for p in rest])


def sizes(df: DataFrame, content: str, carry: Sequence[str], path: str = DEFAULT) -> DataFrame:
    """``carry`` and ``n_tokens`` of every row; a null or empty text has 0 tokens."""
    ship(df.sparkSession)
    counter = Counter(path)
    names = [f"{RESERVED}k{i}" for i in range(len(carry))]
    narrow = df.select(*[F.col(c).alias(n) for c, n in zip(carry, names)], F.col(content).alias(RESERVED + "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[names].assign(n_tokens=[counter.count(t) for t in batch[RESERVED + "text"]])

    types = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(carry, names))
    out = spread(narrow).mapInPandas(run, f"{types}, n_tokens bigint")
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names)], "n_tokens")
