"""Words and hashes of texts, shared by the operators that run in Arrow batches.

Texts travel as UTF-8 bytes: ``bytes.lower`` touches A-Z only and ``bytes.split`` cuts at exactly ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: Bytes of letters, digits and non-ASCII characters stay (A-Z lower-cased); every other byte becomes a space.
ALNUM = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z; none for null."""
    return text.translate(ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; none for null."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, in order; empty if there are fewer."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = h[:size].copy()
    for j in range(1, n):
        out *= STEP
        out += h[j : j + size]
    return mixed(out)


def packed(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, body): the columns ``keep`` (all by default) as one struct, so no added column can clash, and the text as bytes."""
    names = df.columns if keep is None else keep
    return df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").cast("binary").alias("body"))


def released(kernel):
    """The kernel of a task, which gives Arrow's freed memory back to the system when the task is over: workers live on."""

    @functools.wraps(kernel)
    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run
