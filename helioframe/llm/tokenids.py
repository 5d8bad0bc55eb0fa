"""Token-ID output: documents as one concatenated id array with Elias-Fano encoded document boundaries.

Documents are dealt to parts by ranges of ``doc_id`` and encoded there, so ids never cross the network.  A part is written
as blocks of at most ``block_ids`` ids (one document more at most), each one binary value of a Parquet row::

    int64 x 9   magic, documents, documents with null id, ids, first doc_id, and the low width and rank count of the two sequences
    sequence    doc_id minus the first doc_id, for documents with an id
    sequence    end of every document in the id array
    uint16      ids (uint32 where the vocabulary needs it; the magic says which)

A sequence (Elias-Fano) keeps the low bits of each value packed, the high bits as unary gaps in a bit vector, and the byte
position of every 512th set bit, so ``Sequence.select`` finds any offset by reading a few bytes and no 64-bit table exists.
``start`` counts the ids of all blocks before: sums per part, then inside each part.

Defined cases: null text is an empty document (its end id alone); null ids come first; equal ids stand in an order
fixed by hashes of their texts; empty tables give no rows; further input columns are not written.
"""

from __future__ import annotations

import functools
import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, run_dir
from .text import released

END_ID = 2
BLOCK_IDS = 4_000_000
MAGIC = {2: 0x31444944, 4: 0x32444944}
EVERY = 512
MEMO = 1_000_000


class Sequence:
    """Elias-Fano coding of a non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.ranks = n, width, low, high, ranks

    @classmethod
    def encode(cls, values: np.ndarray) -> Sequence:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) // 8 + 1 if n else 0, np.uint8)
        np.bitwise_or.at(high, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return cls(n, width, np.packbits(bits.ravel(), bitorder="little"), high, at[::EVERY].astype(np.uint32))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ranks]

    @classmethod
    def read(cls, blob, at: int, n: int, width: int, size: int) -> tuple[Sequence, int]:
        """The sequence stored at byte ``at`` and the byte after it; ``size`` is the length of its bit vector."""
        parts = []
        for kind, count in ((np.uint8, -(-n * width // 8)), (np.uint8, size), (np.uint32, -(-n // EVERY))):
            parts.append(np.frombuffer(blob, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, width, *parts), at

    def _low(self, i: int) -> int:
        a = i * self.width
        chunk = int.from_bytes(self.low[a >> 3 : ((a + self.width - 1) >> 3) + 1].tobytes(), "little") if self.width else 0
        return chunk >> (a & 7) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """Value ``i`` alone."""
        at, left = int(self.ranks[i // EVERY]), i % EVERY
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        return (at - i) << self.width | self._low(i)

    def decode(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.width).reshape(self.n, self.width)
        low = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))
        return ((at - np.arange(self.n)) << self.width) + low


class Block:
    """Read access to one block: ``offset(i)``, ``tokens(i)``, ``doc_ids()``, ``ends()``."""

    def __init__(self, blob: bytes) -> None:
        magic, self.n, self.nulls, self.n_ids, self.first, w1, s1, w2, s2 = np.frombuffer(blob, np.int64, 9).tolist()
        kind = {v: k for k, v in MAGIC.items()}[magic]
        self.docs, at = Sequence.read(blob, 72, self.n - self.nulls, w1, s1)
        self.bounds, at = Sequence.read(blob, at, self.n, w2, s2)
        self.ids = np.frombuffer(blob, f"<u{kind}", self.n_ids, at)

    @staticmethod
    def pack(doc_ids: list[int | None], ends: np.ndarray, ids: bytes, wide: int) -> bytes:
        known = np.array([d for d in doc_ids if d is not None], np.int64)
        first = int(known[0]) if len(known) else 0
        a, b = Sequence.encode(known - first), Sequence.encode(ends)
        head = [MAGIC[wide], len(doc_ids), len(doc_ids) - len(known), len(ids) // wide, first, a.width, len(a.high), b.width, len(b.high)]
        return b"".join([np.array(head, "<i8").tobytes(), *(x.tobytes() for x in a.arrays() + b.arrays()), ids])

    def offset(self, i: int) -> int:
        """Where document ``i`` starts in the id array of the block."""
        return self.bounds.select(i - 1) if i else 0

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.offset(i) : self.bounds.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.docs.decode() + self.first).tolist()

    def ends(self) -> np.ndarray:
        return self.bounds.decode()


#: A run of white space: all but its last character are a piece of their own, at the end of a text the whole run is.
GAP = re.compile(r"(\s\s+)")
#: The same in RE2, and what is never cut: a control character, or a full stop or comma behind a sign, which may be one piece with it.
SPACE = r"\p{Z}\t-\r\x{85}"
GAPS = f"[{SPACE}][{SPACE}]"
WHOLE = r"[\x00\x1c-\x1f]|[^\p{L}\p{N}" + SPACE + "][.,]"
#: Where a text without runs is cut; a space stays with the full stop or comma behind it.
MARKS = [(" ", "\0 "), (".", "\0."), (",", "\0,"), ("\n", "\0\n\0"), ("\0 \0.", "\0 ."), ("\0 \0,", "\0 ,")]
#: In place of ids: the part touches white space, so its text is encoded as a whole.
ODD = object()
#: Words that are learnt in one text: longer ones cost more a word.
TOGETHER = 500


class Encoder:
    """Ids of whole texts by the tokenizers library, remembering the ids of their parts.

    A text is cut before every space, full stop and comma and around every line end; a space stays with the full stop or comma behind
    it, and runs of white space are cut as ``GAP`` says.  Except in texts with special tokens and in those that ``WHOLE`` names,
    the vocabulary's pattern cuts there too, so a part has the same ids in every text.  Cutting, finding the distinct parts of
    a batch and putting their ids together are array operations; Python sees distinct parts only.

    Parts are kept in two generations: when the younger one is full it becomes the older one, from which parts that occur
    again move back.  So frequent parts stay, and rare ones are forgotten in time; both hold ``MEMO`` parts at most.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.wide = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.kind = {2: "H", 4: "I"}[self.wide]
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes | object] = {}
        self.older: dict[str, bytes | object] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: set[str]) -> None:
        again = parts & self.older.keys()
        self.parts.update((p, self.older[p]) for p in again)
        parts = parts - again
        words = [p for p in parts if p[:1] == " " and p[1:].isalpha()]
        if words:  # many in one text: a token with a space in front starts each
            raw = b"".join(self._ids(["".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]))
            at = np.flatnonzero(self.spaced[np.frombuffer(raw, f"<u{self.wide}")]) * self.wide
            if len(at) != len(words):
                raise ValueError("a word has more than one token with a space in front")
            at = at.tolist()
            self.parts.update((w, raw[a:b]) for w, a, b in zip(words, at, [*at[1:], len(raw)]))
        rest = list(parts - self.parts.keys())
        fits = lambda p: not p or p.isspace() or not (p.removeprefix(" ")[:1].isspace() or p[-1].isspace())
        self.parts.update(zip(rest, [ids if fits(p) else ODD for p, ids in zip(rest, self._ids(rest))]))

    def lookup(self, parts: list[str]) -> list:
        """What is known of distinct parts, after learning the others."""
        found = list(map(self.parts.get, parts))
        if None in found:
            self.learn({p for p, ids in zip(parts, found) if ids is None})
            found = list(map(self.parts.get, parts))
        return found

    @staticmethod
    def cut(text: str) -> list[str]:
        def marked(t: str) -> list[str]:
            t = t.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0")
            if "\0 \0" in t:
                t = t.replace("\0 \0.", "\0 .").replace("\0 \0,", "\0 ,")
            return t.split("\0")

        if not GAP.search(text):
            return marked(text)
        pieces = GAP.split(text)
        out = marked(pieces[0]) if pieces[0] else []
        for run, words in zip(pieces[1::2], pieces[2::2]):
            if words:
                out.append(run[:-1])
                out += marked(run[-1] + words)
            else:  # the end of the text
                out.append(run)
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of every text.  The millions of short-lived strings form no cycles, so the cycle collector waits meanwhile."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), ""))
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array) -> list[bytes]:
        if len(self.parts) > MEMO // 2:
            self.parts, self.older = {}, self.parts
        whole = pc.match_substring_regex(texts, WHOLE)
        for special in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        gaps = pc.and_not(pc.match_substring_regex(texts, GAPS), whole)
        plain = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        out: list[bytes | None] = [None] * len(texts)
        for kind in ("even", "gaps"):
            at = np.flatnonzero((gaps if kind == "gaps" else pc.invert(pc.or_(gaps, whole))).to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            some = texts if len(at) == len(texts) else texts.take(at)
            if kind == "even":
                for what, with_ in MARKS:
                    some = pc.replace_substring(some, what, with_)
                parts = pc.split_pattern(some, "\0")
            else:
                parts = pa.array([self.cut(t) for t in some.to_pylist()], pa.list_(pa.string()))
            plain += self._gather(parts, at, out)
        for k, ids in zip(plain, self._ids([texts[k].as_py() for k in plain])):
            out[k] = ids
        return out

    def _gather(self, parts: pa.ListArray, at: np.ndarray, out: list) -> list[int]:
        """Puts the ids of the cut texts into ``out`` at the places ``at``; returns the places of texts with an odd part."""
        coded = parts.flatten().dictionary_encode()
        found = self.lookup(coded.dictionary.to_pylist())
        odd = np.fromiter((ids is ODD for ids in found), bool, len(found))
        found = [b"" if ids is ODD else ids for ids in found] if odd.any() else found
        code = coded.indices.to_numpy()
        first = np.concatenate(([0], np.cumsum(parts.value_lengths().to_numpy())[:-1]))  # every text has a part
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.wide
        start, n = np.cumsum(size) - size, size[code]
        ends = np.cumsum(n)
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        places = np.repeat((start[code] - ends + n).astype(kind), n)
        places += np.arange(ends[-1], dtype=kind)
        raw = np.frombuffer(b"".join(found), f"<u{self.wide}")[places].tobytes()
        cuts = [0, *(np.append(ends[first[1:] - 1], ends[-1]) * self.wide).tolist()]
        for k, a, b in zip(at.tolist(), cuts, cuts[1:]):
            out[k] = raw[a:b]
        return at[np.add.reduceat(odd[code].astype(np.int64), first) > 0].tolist() if odd.any() else []


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, step: int = 1024) -> None:
    """Write the documents in ascending ``doc_id`` order as (part, block, n_docs, n_ids, body) rows under ``path``."""

    @released
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        end = np.array([end_id], f"<u{tool.wide}").tobytes()
        part, block, ids, doc_ids, parts = None, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, ids
            ends = np.cumsum([len(p) // tool.wide for p in parts])
            body = Block.pack(doc_ids, ends, b"".join(parts), tool.wide)
            made = [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([ids], pa.int64()), pa.array([body], pa.binary())]
            block, ids = block + 1, 0
            doc_ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(made, names=["part", "block", "n_docs", "n_ids", "body"])

        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                part = some.column(0)[0].as_py()
                for d, raw in zip(some.column(1).to_pylist(), tool.encode(some.column(2))):
                    doc_ids.append(d)
                    parts.append(raw + end)
                    ids += len(parts[-1]) // tool.wide
                    if ids >= block_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    ordered.mapInArrow(blocks, "part int, block long, n_docs long, n_ids long, body binary").write.option("compression", "none").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, start): the ids before every block."""
    sizes = spark.read.parquet(path).select("part", "block", "n_ids")
    before = lambda *by: Window.partitionBy(*by[1:]).orderBy(by[0]).rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("base"))
    inside = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(before("block", "part")), F.lit(0)).alias("inner"))
    return inside.join(parts, "part").select("part", "block", (F.col("base") + F.col("inner")).alias("start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document as the files hold it; ``ids`` are unsigned 32-bit little-endian bytes."""

    @released
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block(body.as_py())
                ends = block.ends()
                begins = np.concatenate(([0], ends[:-1]))
                doc_ids, raw = block.doc_ids(), block.ids.astype("<u4")
                for at in range(0, block.n, 1000):
                    a, b = begins[at : at + 1000], ends[at : at + 1000]
                    made = [pa.array(doc_ids[at : at + 1000], pa.int64()), pa.array(a + start), pa.array(b - a), pa.array([raw[x:y].tobytes() for x, y in zip(a, b)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "n_tokens", "ids"])

    offsets = cut_lineage(starts(spark, path), "starts")  # as files its size is known, so Spark broadcasts it only where that is small
    bodies = spark.read.parquet(path).join(offsets, ["part", "block"]).select("start", "body")
    return bodies.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(documents: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write to a new folder below the shared one and read back, with ids_crc32."""
    path = run_dir(documents.sparkSession, "token-ids")
    write(documents, path, tokenizer, **options)
    out = read(documents.sparkSession, path)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
