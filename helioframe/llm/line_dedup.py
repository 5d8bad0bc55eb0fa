"""Line dedup: a sharded minimal perfect hash over line hashes indexes fingerprint and count arrays that documents probe.

1. Every document contributes each of its distinct line keys once; batches add up equal keys before the shuffle, so a line
   that every document has reaches the shuffle once per batch.
2. Keys of at least ``least`` documents are dealt by hash to shards of about ``shard_keys`` keys.  One task per shard builds
   a minimal perfect hash (levels of collision-free bit arrays) and, at each key's slot, a 48-bit fingerprint of the key's
   hash and its document count.  Shards are written to the shared folder.
3. Shards are counted, then broadcast in groups of at most ``max_keys`` keys (about 9 bytes a key); documents probe one
   group after the other, without a join.  With more than one group the marks are written to the shared folder in between.

Keys are lines stripped of ``[\\x20\\x09-\\x0D]`` at both ends and A-Z lower-cased, known by their 64-bit hash.
Defined cases: a null or empty text is one empty line; empty keys are never dropped; a text whose lines all go becomes the
empty string; a key repeated inside one document counts once; repeated rows of one document count as documents of
their own; empty tables give no rows; input columns travel inside ``row`` and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from ..session import cut_lineage
from .text import STEP, mixed, packed

LEAST_DOCS = 10
SHARD_KEYS = 100_000
MAX_KEYS = 8_000_000
LEVELS = 48


def line_keys(body: bytes) -> np.ndarray:
    """Hash of each line's key; 0 stands for an empty key."""
    keys = [line.strip() for line in body.lower().split(b"\n")]
    return np.fromiter([xxh3_64_intdigest(k) or 1 if k else 0 for k in keys], np.uint64, len(keys))


def key_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(h, docs): number of documents with the line key; empty keys are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.unique(line_keys(b)) for b in batch.column(0).to_pylist() if b]
            h, n = np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]), return_counts=True)
            full = h != 0
            yield pa.RecordBatch.from_arrays([pa.array(h[full].view(np.int64)), pa.array(n[full].astype(np.int64))], names=["h", "n"])

    bodies = documents.select(F.col(f"`{text}`").cast("binary").alias("body"))
    return bodies.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("docs"))


def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(keys + np.uint64(level + 1) * STEP) % np.uint64(size)


class Shard:
    """Minimal perfect hash of a set of 64-bit keys with a fingerprint and a count at every key's slot."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray) -> None:
        self.bits, self.base, left, done = [], [], keys, 0
        while len(left):
            if len(self.bits) == LEVELS:
                raise ValueError("keys are not distinct")
            at = slots(left, len(self.bits), 2 * len(left))
            alone = np.bincount(at.astype(np.int64), minlength=2 * len(left)) == 1
            self.bits.append(np.packbits(alone, bitorder="little"))
            self.base.append(done + np.concatenate(([0], np.cumsum(np.bitwise_count(self.bits[-1]), dtype=np.int64))))
            done += int(alone.sum())
            left = left[~alone[at]]
        self.sizes, left = [], len(keys)
        for level, bits in enumerate(self.bits):
            self.sizes.append(2 * left)
            left = len(keys) - int(self.base[level][-1])
        at = self.slot(keys)
        self.low, self.high = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint16)
        self.docs = np.zeros(len(keys), np.uint32)
        self.low[at], self.high[at] = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16)
        self.docs[at] = np.minimum(docs, 2**32 - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 where no level has a bit for it."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, size) in enumerate(zip(self.bits, self.sizes)):
            at = slots(keys[open_], level, size).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (bits[byte] >> bit) & 1 == 1
            below = np.bitwise_count(bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[hit]] = (self.base[level][byte] + below)[hit]
            open_ = open_[~hit]
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Document counts of the keys; 0 for a key that is not in the set."""
        at = self.slot(keys)
        same = (at >= 0) & (self.low[at] == keys.astype(np.uint32)) & (self.high[at] == (keys >> np.uint64(32)).astype(np.uint16))
        return np.where(same, self.docs[at], 0)

    def dumps(self) -> bytes:
        arrays = [np.array([len(self.low), len(self.bits)], np.int64), np.array(self.sizes, np.int64), *self.bits, self.low, self.high, self.docs]
        return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)

    @classmethod
    def loads(cls, blob: bytes) -> Shard:
        self, at = cls.__new__(cls), 0

        def take(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        n, levels = take(np.int64, 2).tolist()
        self.sizes = take(np.int64, levels).tolist()
        self.bits = [take(np.uint8, -(-size // 8)) for size in self.sizes]
        self.low, self.high, self.docs = take(np.uint32, n), take(np.uint16, n), take(np.uint32, n)
        self.base, done = [], 0
        for bits in self.bits:
            self.base.append(done + np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64))))
            done = int(self.base[-1][-1])
        return self


def index(counts: DataFrame, least: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(shard, shards, keys, blob) for the keys of at least ``least`` documents."""
    frequent = cut_lineage(counts.where(F.col("docs") >= least), "lines")
    shards = max(1, -(-frequent.count() // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("h").to_numpy().view(np.uint64)
        blob = Shard(keys, table.column("docs").to_numpy()).dumps()
        return pa.table({"shard": table.column("shard").slice(0, 1), "shards": pa.array([shards], pa.int64()), "keys": pa.array([len(keys)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    dealt = frequent.withColumn("shard", F.shiftrightunsigned("h", 33) % shards)
    return cut_lineage(dealt.groupBy("shard").applyInArrow(build, "shard long, shards long, keys long, blob binary"), "index")


def probe(documents: DataFrame, shards: DataFrame, least: int = LEAST_DOCS, text: str = "text", max_keys: int = MAX_KEYS, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (its columns ``keep``, all by default), n_lines, n_dropped, kept (the text without its frequent lines)."""
    sizes = shards.select("shard", "keys").orderBy("shard").toLocalIterator()
    groups, filled = [[]], 0
    for r in sizes:
        if filled and filled + r.keys > max_keys:
            groups.append([])
            filled = 0
        groups[-1].append(r.shard)
        filled += r.keys
    out = packed(documents, text, keep).withColumn("marks", F.lit(None).cast("binary"))
    schema = out.schema
    final = T.StructType([schema["row"], *T._parse_datatype_string("n_lines long, n_dropped long, kept binary").fields])
    for k, group in enumerate(groups):
        mine = shards.where(F.col("shard").between(group[0], group[-1])).collect() if group else []
        sent = documents.sparkSession.sparkContext.broadcast([(r.shard, r.shards, bytes(r.blob)) for r in mine])
        last = k == len(groups) - 1
        out = out.mapInArrow(_prober(sent, least, last, (final if last else schema).names), final if last else schema)
        if not last:
            out = cut_lineage(out, "marked")
    return out.withColumn("kept", F.col("kept").cast("string"))


def _prober(sent, least: int, last: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {shard: Shard.loads(blob) for shard, _, blob in sent.value}
        shards = sent.value[0][1] if sent.value else 1
        for batch in batches:
            bodies = [b or b"" for b in batch.column(1).to_pylist()]
            each = [line_keys(b) for b in bodies]
            keys, back = np.unique(np.concatenate([*each, np.empty(0, np.uint64)]), return_inverse=True)
            drop = np.zeros(len(keys), bool)
            owner = (keys >> np.uint64(33)) % np.uint64(shards)
            for shard, table in loaded.items():
                mine = np.flatnonzero((owner == shard) & (keys != 0))
                drop[mine] = table.counts(keys[mine]) >= least
            ends = np.cumsum([len(e) for e in each])
            marks = [m for m in np.split(drop[back], ends[:-1])] if each else []
            before = batch.column(2).to_pylist()
            marks = [m | np.unpackbits(np.frombuffer(b, np.uint8), count=len(m)).astype(bool) if b else m for m, b in zip(marks, before)]
            if last:
                kept = [b"\n".join([x for x, m in zip(body.split(b"\n"), mark.tolist()) if not m]) if mark.any() else body for body, mark in zip(bodies, marks)]
                made = [pa.array([len(m) for m in marks], pa.int64()), pa.array([int(m.sum()) for m in marks], pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)
            else:
                packed_marks = pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed_marks], names=names)

    return run


def dedup_lines(documents: DataFrame, least: int = LEAST_DOCS, text: str = "text", shard_keys: int = SHARD_KEYS, max_keys: int = MAX_KEYS, keep: list[str] | None = None) -> DataFrame:
    return probe(documents, index(key_counts(documents, text), least, shard_keys), least, text, max_keys, keep)
