"""Benchmark decontamination: broadcast hash set of benchmark n-grams, scan of every document, verified hits.

A window is ``n`` consecutive words of a benchmark item; an item with fewer words, but at least one, is one window.  The
windows are made by Spark and counted first.  Up to ``max_windows`` (window, item) rows are collected and broadcast; more
are dealt by hash into as many parts, and the documents are scanned once per part (each scan written to the shared folder
before the next), so memory stays bounded and no window is left out.

Defined cases: a null or empty text has no words, no hits and is clean; a null or empty item has no window; items without
an id hit words but are not listed; repeated items count once per id; repeated documents are judged one by one; an empty
benchmark or document table gives clean or no rows; input columns travel inside ``row`` and cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .text import ALNUM, alnum_words, packed, window_hashes, word_hashes

WINDOW = 13
MAX_WINDOWS = 250_000
FILTER_BITS = 20
FOUND = "n_words long, n_hit long, hits array<bigint>, cuts array<bigint>, items array<string>"


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct (h, size, gram, item): hash, number of words, words joined by one space, id as text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alnum_words(body)
                if words:
                    size = min(n, len(words))
                    hashes = window_hashes(word_hashes(words), size).view(np.int64).tolist()
                    rows += {(h, size, b" ".join(words[i : i + size]), item) for i, h in enumerate(hashes)}
            names = ("h", "size", "gram", "item")
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names=list(names))

    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("binary").alias("body"))
    return items.mapInArrow(cut, "h long, size int, gram binary, item string").distinct()


class Probe:
    """A bit table in front of a dictionary from window hash to the windows and items behind it."""

    def __init__(self, rows: list) -> None:
        self.grams: dict[int, dict[bytes, set]] = {}
        self.sizes = sorted({r.size for r in rows})
        for r in rows:
            self.grams.setdefault(r.h & (2**64 - 1), {}).setdefault(bytes(r.gram), set()).add(r.item)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[np.fromiter(self.grams, np.uint64, len(self.grams)) >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """(first word, number of words, items) of every verified occurrence."""
        for size in self.sizes:
            h = window_hashes(hashes, size)
            for i in np.flatnonzero(self.bits[h >> np.uint64(64 - FILTER_BITS)]).tolist():
                for gram, items in self.grams.get(int(h[i]), {}).items():
                    if gram.count(b" ") + 1 == size and gram == b" ".join(words[i : i + size]):
                        yield i, size, items


def scan(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (its columns ``keep``, all by default), n_words, n_hit, hits, cuts, items.

    ``hits`` lists first and last-plus-one word of every hit run, ``cuts`` the same runs as byte offsets in the text,
    ``items`` the sorted ids of the items with an occurring window.
    """
    found = cut_lineage(windows(benchmark, item_id, item_text, n), "windows")
    parts = max(1, -(-found.count() // max_windows))
    out = packed(documents, text, keep)
    if keep is None or text in keep:  # the text inside the row serves
        out, body = out.drop("body"), F.col(f"row.`{text}`").cast("binary")
    else:
        body = F.col("body")
    for part in range(parts):
        mine = found.where(F.pmod(F.xxhash64("h", "item"), F.lit(parts)) == part)
        probe = documents.sparkSession.sparkContext.broadcast(Probe(mine.collect()))
        before = [F.col("found")] if part else []
        out = out.withColumn("found", _scanner(probe)(body, *before))
        if part < parts - 1:
            out = cut_lineage(out, "scanned")
    return out.select("row", "found.*")


def runs_of(mask: np.ndarray) -> list[int]:
    """First and last-plus-one position of every run of true values."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()


def _scanner(probe):
    """Finds of one part added to those of the parts before; only texts go to Python, rows stay in the JVM."""

    @F.arrow_udf(T._parse_datatype_string(FOUND))
    def scan_batch(*columns: pa.Array) -> pa.Array:
        made: dict[str, list] = {"n_words": [], "n_hit": [], "hits": [], "cuts": [], "items": []}
        so_far = [columns[1].field(k).to_pylist() for k in ("hits", "items")] if len(columns) > 1 else None
        for k, value in enumerate(columns[0]):
            body = value.as_py()
            words = alnum_words(body)
            mask, ids = np.zeros(len(words), bool), set()
            if so_far:
                ids.update(so_far[1][k])
                for a, b in zip(so_far[0][k][::2], so_far[0][k][1::2]):
                    mask[a:b] = True
            for i, size, items in probe.value.find(words, word_hashes(words)):
                mask[i : i + size] = True
                ids |= items
            hits = runs_of(mask)
            at = [m.span() for m in re.finditer(rb"[^ ]+", body.translate(ALNUM))] if hits else []
            made["n_words"].append(len(words))
            made["n_hit"].append(int(mask.sum()))
            made["hits"].append(hits)
            made["cuts"].append([at[w][0] if k % 2 == 0 else at[w - 1][1] for k, w in enumerate(hits)])
            made["items"].append(sorted(x for x in ids if x is not None))
        kinds = {"hits": pa.list_(pa.int64()), "cuts": pa.list_(pa.int64()), "items": pa.list_(pa.string())}
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays([pa.array(v, kinds.get(n, pa.int64())) for n, v in made.items()], names=list(made))

    return scan_batch.asNondeterministic()  # a later filter is not pushed below it, which would scan twice


def contaminated(share: int = 20):
    """At least one word in ``share`` is hit, and one at all."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def remove_spans(scanned: DataFrame, text: str = "text") -> DataFrame:
    """The input columns with the hit runs cut out of the text; null stays null."""
    body = F.col(f"row.`{text}`").cast("binary")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts"), F.array(F.octet_length(F.col(f"row.`{text}`")).cast("long")))
    keep = F.transform(F.sequence(F.lit(0), (F.size("cuts") / 2).cast("int")), lambda i: F.substring(body, F.get(edges, 2 * i).cast("int") + 1, (F.get(edges, 2 * i + 1) - F.get(edges, 2 * i)).cast("int")))
    cut = F.aggregate(keep, F.lit(b""), lambda a, b: F.concat(a, b)).cast("string")
    kept = scanned.withColumn("_cut", F.when(F.size("cuts") > 0, cut).otherwise(F.col(f"row.`{text}`")))
    names = kept.schema["row"].dataType.names
    return kept.select(*[F.col("_cut").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names])


def remove_documents(scanned: DataFrame, share: int = 20) -> DataFrame:
    """The input columns of the documents that are not contaminated."""
    return scanned.where(~contaminated(share)).select("row.*")
