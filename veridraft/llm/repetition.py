"""Repetition inside one document: the share of words and characters that say something again.

Words of a batch of documents become numbers; polynomial rolling hashes of several n-gram lengths run
over all of them at once in numpy. An n-gram is repeated where its hash was met before in the same
document, and every word inside a second or later occurrence counts, so overlapping loops are
covered in full. Lines repeated whole are measured likewise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.llm.text import clean, fold, folded_words, mix
from veridraft.session import RESERVED, ship, spread

#: Lengths of n-grams in words; the first decides.
LENGTHS = (5, 10, 20)
#: Share of repeated words from which a text says the same thing over and over.
LIMIT = 1 / 3
#: Documents hashed at once.
CHUNK = 2048

_BASE = np.uint64(0x100000001B3)


def _repeated(numbers: np.ndarray, docs: np.ndarray, room: np.ndarray, n: int) -> np.ndarray:
    """Which items lie in a second or later occurrence of an n-gram of their document. ``room``:
    items from here to the document's end."""
    size = len(numbers)
    covered = np.zeros(size, bool)
    starts = np.flatnonzero(room >= n)
    if not len(starts):
        return covered
    h = np.zeros(len(starts), np.uint64)
    for j in range(n):
        h = h * _BASE + numbers[starts + j]
    h = mix(h ^ mix(docs[starts] + np.uint64(n)))
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(starts), bool)
    again[order[1:]] = h[order[1:]] == h[order[:-1]]
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, starts[again], 1)
    np.add.at(edges, starts[again] + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(texts: Sequence[str]) -> pd.DataFrame:
    """For each text: n_words, the share of repeated words for each n-gram length, of characters in
    repeated n-grams of the first length, and of characters in repeated lines. A text without words
    has shares of 0."""
    parts = [_measure(texts[i : i + CHUNK]) for i in range(0, len(texts), CHUNK)] or [_measure([])]
    return pd.concat(parts, ignore_index=True)


def _measure(texts: Sequence[str]) -> pd.DataFrame:
    known: dict[str, int] = {}
    numbers: list[int] = []
    sizes, lengths, counts, lines, line_sizes, line_counts = [], [], [], [], [], []
    for text in texts:
        text = clean(text)
        folded, found = fold(text), folded_words(text)
        for w in found:
            numbers.append(known.setdefault(w, len(known) + 1))
        lengths.extend(map(len, found))
        counts.append(len(found))
        rows = [r for r in map(str.strip, folded.split("\n")) if r]
        lines.extend(xxhash.xxh3_64_intdigest(r.encode("utf-8", "surrogatepass")) for r in rows)
        line_sizes.extend(map(len, rows))
        line_counts.append(len(rows))
    out = {"n_words": np.array(counts, np.int64)}

    def shares(values, count, n, weights) -> np.ndarray:
        count = np.array(count, np.int64)
        docs = np.repeat(np.arange(len(count)), count)
        ends = np.repeat(np.cumsum(count), count)
        hit = _repeated(np.array(values, np.uint64), docs.astype(np.uint64), ends - np.arange(len(docs)), n)
        total = np.bincount(docs, weights, len(count))
        return np.divide(np.bincount(docs, weights * hit, len(count)), total, out=np.zeros(len(count)), where=total > 0)

    ones, chars = np.ones(len(numbers)), np.array(lengths, float)
    for n in LENGTHS:
        out[f"repeated_{n}"] = shares(numbers, counts, n, ones)
    out["repeated_chars"] = shares(numbers, counts, LENGTHS[0], chars)
    out["repeated_lines"] = shares(lines, line_counts, 1, np.array(line_sizes, float))
    return pd.DataFrame(out)


_FIELDS = "n_words bigint, " + ", ".join(f"repeated_{n} double" for n in LENGTHS) + ", repeated_chars double, repeated_lines double"


def repetition(df: DataFrame, content: str, keys: Sequence[str]) -> DataFrame:
    """``keys`` with the measures of ``measure`` for every row.

    A null or empty text has no words and shares of 0. Keys may be null, repeated rows come out
    repeated, an empty table gives an empty table. Only ``keys`` and ``content`` are read, whole texts
    always; a text never leaves its task.
    """
    ship(df.sparkSession)
    names = [f"{RESERVED}k{i}" for i in range(len(keys))]
    narrow = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(content).alias(RESERVED + "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([batch[names].reset_index(drop=True), measure(batch[RESERVED + "text"].tolist())], axis=1)

    types = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for k, n in zip(keys, names))
    out = spread(narrow).mapInPandas(run, f"{types}, {_FIELDS}")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *[c for c in out.columns if c not in names])
