"""Stupid-backoff scores of documents under the word-pair counts of the whole corpus.

    S(w2 | w1) = c(w1 w2) / c(w1)            if the pair is in the table: seen at least ``least`` times
                 alpha * c(w2) / N           otherwise
    S(first word) = c(w) / N

A document's score is the sum of log S over its words.  Counts cover every document, in a few passes over the texts:

1. Word counts, added up inside each Arrow batch before the shuffle, stay a Spark table.  Only hot words, those above
   max(``hot_floor``, N / 1,000,000), a million at most, are broadcast with their counts.
2. Pairs above the same bound: candidates are pairs frequent inside a batch; they are counted exactly and broadcast as well.
   They never enter the shuffle, so no hash partition is hot.
3. Every other pair goes to a hash bucket: that of its first word, or, where that is hot, of the pair itself.  So the bucket's
   task holds all of the pair's and of the other first words' occurrences (a text's last word goes there alone) and counts
   both exactly.  Pairs, texts and words are packed per batch and bucket, words as codes into the words of that pack.
4. Pairs that back off ask for the count of their second word in a second exchange, by the word's bucket, which gets that
   count from the task in 3.  Either kind of bucket grows in number with the corpus, not in size.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased, known by 64-bit hashes, a pair by a hash of both.
Defined cases: null, empty and blank texts have no words and score 0 (per word: null); rows that share an id are scored
together; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import STEP, mixed, space_words, word_hashes

ALPHA, LEAST = 0.4, 2
BUCKET_PAIRS, HOT_FLOOR, IN_BATCH = 2_000_000, 20_000, 8
NO_ID = np.iinfo(np.int64).min
PACK = {"bucket": "long", "docs": "binary", "sizes": "binary", "words": "binary", "codes": "binary", "heads": "binary", "head_docs": "binary", "ends": "binary"}
ASK = {"bucket": "long", "words": "binary", "times": "binary", "docs": "binary", "base": "binary", "asked": "binary", "askers": "binary"}


def coded(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct words of a batch, the place of every word among them, and the words of each text."""
    each = [word_hashes(space_words(b.as_py())) for b in bodies]
    known, codes = np.unique(np.concatenate([*each, np.empty(0, np.uint64)]), return_inverse=True)
    return known, codes, np.array([len(e) for e in each], np.int64)


def pairs_of(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second words of all pairs of consecutive words, and the text each belongs to."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    inside = doc[1:] == doc[:-1]
    return codes[:-1][inside], codes[1:][inside], doc[1:][inside]


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * STEP + mixed(second))


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in a sorted table, and whether they are there."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]


def _collect(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table of (key, n), sorted by the unsigned key."""
    table = df.toArrow()
    key, n = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _packs(rows: list[dict], schema: dict) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table({k: pa.array([r.get(k, b"") for r in rows], kinds[t]) for k, t in schema.items()})


def _ddl(schema: dict) -> str:
    return ", ".join(f"{k} {t}" for k, t in schema.items())


def _read(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in table.column(name).to_pylist()] + [np.empty(0, kind)])


def tables(bodies: DataFrame, hot_floor: int = HOT_FLOOR) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, the sorted hot words and their counts, the sorted hot pairs and their counts."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, codes, lengths = coded(batch.column(1))
            w1, w2, _ = pairs_of(codes, lengths)
            pair, times = np.unique(pair_keys(known[w1], known[w2]), return_counts=True)
            many = times >= IN_BATCH
            keys, n = np.concatenate((known, pair[many])), np.concatenate((np.bincount(codes, minlength=len(known)), times[many]))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(known), many.sum()])), *_longs(keys, n)], names=["kind", "key", "n"])

    counts = cut_lineage(bodies.mapInArrow(first, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "words")
    total = counts.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    floor = max(hot_floor, total // 1_000_000)
    words, n_words = _collect(counts.where(f"kind = 0 and n >= {floor}").select("key", "n"))
    hot, _ = _collect(counts.where(f"kind = 1 and n >= {floor}").select("key", "n"))
    if not len(hot):
        return total, words, n_words, hot, np.empty(0, np.int64)
    sent = bodies.sparkSession.sparkContext.broadcast(hot)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, codes, lengths = coded(batch.column(1))
            w1, w2, _ = pairs_of(codes, lengths)
            at, there = find(sent.value, pair_keys(known[w1], known[w2]))
            at, n = np.unique(at[there], return_counts=True)
            yield pa.RecordBatch.from_arrays(_longs(at, n), names=["key", "n"])

    times = np.zeros(len(hot), np.int64)
    at, n = _collect(bodies.mapInArrow(exact, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    times[at.view(np.int64)] = n
    return total, words, n_words, hot, times


def scores(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA, least: int = LEAST, bucket_pairs: int = BUCKET_PAIRS, hot_floor: int = HOT_FLOOR) -> DataFrame:
    """(doc_id, n_words, log_score, per_word)."""
    bodies = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("body"))
    total, hot_words, word_times, hot_pairs, pair_times = tables(bodies, hot_floor)
    total = max(1, total)
    buckets = max(64, -(-total // bucket_pairs))
    sent = bodies.sparkSession.sparkContext.broadcast((hot_words, np.log(np.maximum(word_times, 1)), hot_pairs, np.log(np.maximum(pair_times, 1))))
    log_total, log_alpha = float(np.log(total)), float(np.log(alpha))

    def home(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) % np.uint64(buckets)).astype(np.int64)

    def split(batch: pa.RecordBatch):
        """Words of a batch with their places among the hot ones, its pairs, and their places among the hot ones."""
        known, codes, lengths = coded(batch.column(1))
        w1, w2, doc = pairs_of(codes, lengths)
        key = pair_keys(known[w1], known[w2])
        some = lengths > 0
        heads, ends = codes[(np.cumsum(lengths) - lengths)[some]], codes[np.cumsum(lengths)[some] - 1]
        return known, find(sent.value[0], known), lengths, (heads, ends, np.flatnonzero(some)), (w1, w2, doc, key), find(sent.value[2], key)

    def score_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hot first words and hot pairs, whose counts are at hand."""
        _, log_word, _, log_pair = sent.value
        for batch in batches:
            _, (place, hot), lengths, (heads, _, owner), (w1, _, doc, _), (at, is_hot) = split(batch)
            base, mine = np.zeros(len(lengths)), hot[heads]
            base[owner[mine]] = log_word[place[heads[mine]]] - log_total
            base += np.bincount(doc[is_hot], log_pair[at[is_hot]] - log_word[place[w1[is_hot]]], len(lengths))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_longs(lengths), pa.array(base)], names=["doc_id", "n_words", "base"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Other pairs, packed per bucket: ids of the texts, how many pairs each has there, the pairs in that order; other first
        words with their texts; other last words."""
        for batch in batches:
            known, (_, hot), _, (heads, ends, owner), (w1, w2, doc, key), (_, is_hot) = split(batch)
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            at_home, rest = home(known), np.flatnonzero(~is_hot)
            bucket = np.where(hot[w1[rest]], home(key[rest]), at_home[w1[rest]])
            order = np.argsort(bucket, kind="stable")  # texts stay in order inside a bucket
            bucket, rest = bucket[order], rest[order]
            owner, heads, ends = owner[~hot[heads]], heads[~hot[heads]], ends[~hot[ends]]
            order = np.argsort(at_home[heads], kind="stable")
            owner, heads, ends = owner[order], heads[order], ends[np.argsort(at_home[ends], kind="stable")]
            edges = [np.searchsorted(b, np.arange(buckets + 1)) for b in (bucket, at_home[heads], at_home[ends])]
            rows = []
            for b in np.flatnonzero(sum(map(np.diff, edges))).tolist():
                p, h, e = (slice(x[b], x[b + 1]) for x in edges)
                mine, sizes = np.unique(doc[rest[p]], return_counts=True)
                words, codes = np.unique(np.concatenate((w1[rest[p]], w2[rest[p]])), return_inverse=True)
                rows.append({
                    "bucket": b, "docs": ids[mine].tobytes(), "sizes": sizes.astype(np.uint32).tobytes(), "words": known[words].tobytes(),
                    "codes": codes.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32).tobytes(),
                    "heads": known[heads[h]].tobytes(), "head_docs": ids[owner[h]].tobytes(), "ends": known[ends[e]].tobytes()})
            yield from _packs(rows, PACK).to_batches()

    def join(table: pa.Table) -> pa.Table:
        """Counts of the bucket's pairs and words; sums by text, the word counts, and what backed-off pairs ask other buckets for."""
        hot_words, log_word, *_ = sent.value
        ids, sizes = _read(table, "docs", np.int64), _read(table, "sizes", np.uint32)
        sides = [], []
        for words, codes in zip(table.column("words").to_pylist(), table.column("codes").to_pylist()):
            words = np.frombuffer(words, np.uint64)
            both = words[np.frombuffer(codes, np.uint16 if len(words) <= 1 << 16 else np.uint32)]
            for side, part in zip(sides, np.split(both, 2)):
                side.append(part)
        w1, w2 = map(np.concatenate, sides)
        owner = np.repeat(ids, sizes)
        _, back, n = np.unique(pair_keys(w1, w2), return_inverse=True, return_counts=True)
        n = n[back]
        at, hot = find(hot_words, w1)
        words, times = np.unique(np.concatenate((w1[~hot], _read(table, "ends", np.uint64))), return_counts=True)
        log_times = np.log(times)
        log_first = np.empty(len(w1))
        log_first[hot], log_first[~hot] = log_word[at[hot]], log_times[np.searchsorted(words, w1[~hot])]
        seen = n >= least
        value = np.where(seen, np.log(n) - log_first, log_alpha - log_total)
        at, hot = find(hot_words, w2)
        value[~seen & hot] += log_word[at[~seen & hot]]
        heads, ask = _read(table, "heads", np.uint64), ~seen & ~hot
        owners, back = np.unique(np.concatenate((owner, _read(table, "head_docs", np.int64))), return_inverse=True)
        base = np.bincount(back, np.concatenate((value, log_times[np.searchsorted(words, heads)] - log_total)), len(owners)).astype(np.float64)
        rows = [{"bucket": table.column("bucket")[0].as_py(), "words": words.tobytes(), "times": times.astype(np.int64).tobytes(), "docs": owners.tobytes(), "base": base.tobytes()}]
        asked, askers = w2[ask], owner[ask]
        bucket = home(asked)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            mine = order[edges[b] : edges[b + 1]]
            rows.append({"bucket": b, "asked": asked[mine].tobytes(), "askers": askers[mine].tobytes()})
        return _packs(rows, ASK)

    def answer(table: pa.Table) -> pa.Table:
        """Counts of the second words that were asked for, and the sums by text."""
        words, times = _read(table, "words", np.uint64), _read(table, "times", np.int64)
        value = np.log(times)[np.searchsorted(words, _read(table, "asked", np.uint64))]
        owners, back = np.unique(np.concatenate((_read(table, "docs", np.int64), _read(table, "askers", np.int64))), return_inverse=True)
        base = np.bincount(back, np.concatenate((_read(table, "base", np.float64), value)), len(owners)).astype(np.float64)
        return pa.table({"doc_id": pa.array(owners, mask=owners == NO_ID), "n_words": pa.array(np.zeros(len(owners), np.int64)), "base": base})

    own = bodies.mapInArrow(score_here, "doc_id long, n_words long, base double")
    dealt = bodies.mapInArrow(deal, _ddl(PACK)).groupBy("bucket").applyInArrow(join, _ddl(ASK))
    parts = dealt.groupBy("bucket").applyInArrow(answer, "doc_id long, n_words long, base double")
    out = own.unionByName(parts).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("base").alias("log_score"))
    return out.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
