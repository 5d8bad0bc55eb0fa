"""MinHash near-duplicates by tensored banding, with every link confirmed on the full shingle sets.

Method.  Two small collections of ``bands`` sub-keys are drawn for every document, each sub-key from ``rows`` minhashes; a
table key joins one sub-key of either collection.  So 2 * bands * rows minhashes (40) serve bands ** 2 tables (100) of
2 * rows minhashes each, instead of 400.  A pair of similarity s shares a key with probability (1 - (1 - s**rows)**bands)**2:
0.9995 at 0.75, 0.99999 at 0.85.

Plan.

1. One pass over the texts gives size, fingerprint and sub-keys of every set; equal sets become one class, known by its
   smallest id (a grouped minimum), and only classes go on.
2. First round: inside each Arrow batch, equal keys form stars around the document that shares most keys, and only the
   star's centre is shuffled; there the centres form stars again.  So a key shared by a third of all documents reaches the
   shuffle once per batch, and candidates grow with documents, not with the square of a bucket.
3. The candidate of each document with its heaviest centre that could reach the threshold by size is confirmed on the whole
   texts, so a group of any size gives a few tests a document; links make components.  Whoever shares a key with another
   class, whatever the sizes, takes part in the rounds that follow.
4. Second round: keys shared by several components, one changing member per component and key, in stars again.
5. Last round: the texts in keys that several components still share go through an exact prefix join across components (rare
   shingles first), so no candidate link between different components is lost and no bucket is expanded into all its pairs.

Defined cases: null, empty or blank texts have no shingle, link with nothing and are kept; fewer words than ``n`` are one
shingle; documents without an id are compared with nothing (component null) and kept; rows that share an id are judged
one by one; empty tables give no rows; input columns travel inside ``row`` and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from ..session import cut_lineage
from .components import components
from .text import mixed, packed, released, space_words, window_hashes, word_hashes

SHINGLE = 5
SHARE = (75, 100)
BANDS, ROWS = 10, 2
_RNG = np.random.default_rng(20240401)
MULTIPLIERS = _RNG.integers(0, 2**63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2**64, 4096, np.uint64)
LONGS = pa.list_(pa.int64())


def shingles(body: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles."""
    words = space_words(body)
    return np.unique(window_hashes(word_hashes(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def sub_keys(shingle_set: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """2 * bands hashes, each of ``rows`` minhashes: the two collections one after the other."""
    low = np.array([(shingle_set * MULTIPLIERS[k] + SHIFTS[k]).min() for k in range(2 * bands * rows)], np.uint64)
    out = np.arange(2 * bands, dtype=np.uint64)
    for column in low.reshape(2 * bands, rows).T:
        out = mixed(out + column)
    return out


def left_keys(subs: np.ndarray, left: int) -> np.ndarray:
    """The table keys of one left sub-key with every right one, for each row of ``subs``."""
    half = subs.shape[1] // 2
    return mixed(subs[:, left, None] * MULTIPLIERS[0] + mixed(subs[:, half:]))


def table_keys(subs: np.ndarray) -> np.ndarray:
    """All pairs of a left and a right sub-key, for each row of ``subs``."""
    return np.concatenate([left_keys(subs, k) for k in range(subs.shape[1] // 2)], axis=1)


def sets(documents: DataFrame, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, f1, f2, subs) of (doc_id, body, text_hash); the fingerprint is null and ``subs`` empty without shingles."""

    @released
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, f1, f2, subs = [], [], [], []
            for body in batch.column(1):
                s = shingles(body.as_py(), n)
                size.append(len(s))
                mark = xxh3_128_intdigest(s.tobytes()) if len(s) else None
                f1.append(None if mark is None else (mark >> 64) - 2**63)
                f2.append(None if mark is None else (mark & (2**64 - 1)) - 2**63)
                subs.append(sub_keys(s, bands, rows).view(np.int64) if len(s) else [])
            made = [pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(subs, LONGS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=["doc_id", "text_hash", "n_shingles", "f1", "f2", "subs"])

    return documents.mapInArrow(make, "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, subs array<bigint>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)


def _close(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Sizes that do not rule the link out: the smaller set is at least the share of the larger."""
    return share[1] * np.minimum(a, b) >= share[0] * np.maximum(a, b)


def _stars(keys, label, ids, size, weight, share):
    """Stars of the entries of each key around its entry of most weight, between labels only.

    -> the entries by key, the first of each, and the meetings (``_meetings``) of the others with it."""
    order = np.lexsort((ids, weight, keys))[::-1]
    k = keys[order]
    first = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
    centre = order[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))] if len(k) else order
    far = (label[order] != label[centre]) & (ids[order] != ids[centre])
    return order, first, _meetings(ids[order], ids[centre], far, size[order], size[centre], np.asarray(weight)[centre], share)


def _meetings(ids, centres, far, size, centre_size, weight, share) -> tuple[np.ndarray, ...]:
    """(id, centre, weight) of the ``far`` entries whose sizes may reach the share, and (id, centre) of those beyond it, once each."""
    close = far & _close(size, centre_size, share)
    a, b, w = ids[close], centres[close], weight[close]
    at = _distinct(a, b, -w)
    c, d = ids[far & ~close], centres[far & ~close]
    some = np.unique(np.concatenate((np.unique(c, return_index=True)[1], np.unique(d, return_index=True)[1])))
    return a[at], b[at], w[at], c[some], d[some]


def _distinct(a: np.ndarray, b: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Positions of the distinct (a, b), each with the least ``then``."""
    order = np.lexsort((then, b, a))
    new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))[: len(a)]
    return order[new]


def _met(found: list[tuple[np.ndarray, ...]], apart: bool) -> pa.RecordBatch:
    """Pairs (id, centre, best) of meetings: of those worth confirming one of each id is best.  Sizes decide what is tested, not who
    takes part in the later rounds: with ``apart``, who met only beyond the size bound comes too, in pairs that are never best."""
    a, b, w, c, d = (np.concatenate(x) for x in zip(*found))
    out = _ranked(a, b, w)
    if not apart:
        return out
    at = np.unique(np.concatenate((np.unique(c, return_index=True)[1], np.unique(d, return_index=True)[1])))
    return pa.concat_batches([out, pa.RecordBatch.from_arrays([pa.array(c[at], pa.int64()), pa.array(d[at], pa.int64()), pa.array(np.zeros(len(at), bool))], names=["a", "b", "best"])])


def _ranked(ids: np.ndarray, centres: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """Distinct (id, centre) with ``best`` true for the centre of most weight of each id."""
    order = np.lexsort((centres, -weight, ids))
    ids, centres = ids[order], centres[order]
    best = np.concatenate(([True], ids[1:] != ids[:-1]))[: len(ids)]
    new = best | np.concatenate(([True], centres[1:] != centres[:-1]))[: len(ids)]
    return pa.RecordBatch.from_arrays([pa.array(ids[new], pa.int64()), pa.array(centres[new], pa.int64()), pa.array(best[new])], names=["a", "b", "best"])


def _deal(by_label: bool, want_pairs: bool, share, salt: int = 0):
    """Map side of a round: stars inside the batch; pairs, or the entries that other batches have to meet.

    One left sub-key after the other: their keys belong to different tables, so a tenth of the batch's keys is held at a time."""

    @released
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            subs = _matrix(batch.column("subs"))
            half = subs.shape[1] // 2
            own = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("id", "label", "n")]
            total = np.zeros(len(subs), np.int64)  # how often the keys of a document occur in the batch
            for left in range(0 if by_label else half):
                back, count = np.unique(left_keys(subs, left).ravel(), return_inverse=True, return_counts=True)[1:]
                total += count[back].reshape(-1, half).sum(1)
            found = []
            for left in range(half):
                flat = left_keys(subs, left).ravel()
                ids, label, size = (np.repeat(x, half) for x in own)
                if by_label:  # one member for each component and key, another one for each key
                    order = np.lexsort((mixed(flat ^ ids.view(np.uint64) ^ np.uint64(salt)), label, flat))
                    k, lab = flat[order], label[order]
                    at = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (lab[1:] != lab[:-1]))))
                    weight = np.diff(np.append(at, len(k)))
                    flat, ids, label, size = k[at], ids[order][at], lab[at], size[order][at]
                else:
                    weight = np.repeat(total, half)
                order, first, meetings = _stars(flat, label, ids, size, weight, share)
                if want_pairs:
                    found.append(meetings)
                else:
                    out = order if by_label else order[first]
                    made = [flat[out].view(np.int64), label[out], ids[out], size[out], weight[out].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["key", "label", "id", "n", "weight"])
            if found:
                yield _met(found, not by_label)

    return deal


def _meet(share, mixed_keys: bool = False, apart: bool = False):
    """Reduce side: rows sorted by key; stars of each key, or the keys that several labels share.  Streams; keys may span batches."""

    @released
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, label, id, size and weight of the running key's centre
        for batch in batches:
            if not batch.num_rows:
                continue
            key, label, ids, size, weight = (batch.column(k).to_numpy() for k in range(5))
            if last is not None:
                key, label, ids, size, weight = (np.concatenate(([x], y)) for x, y in zip(last, (key, label, ids, size, weight)))
            first = np.concatenate(([True], key[1:] != key[:-1]))
            centre = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            far = label != label[centre]
            if mixed_keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[far]), pa.int64())], names=["key"])
            else:
                yield _met([_meetings(ids, ids[centre], far & (ids != ids[centre]), size, size[centre], weight[centre], share)], apart)
            last = tuple(x[centre[-1]] for x in (key, label, ids, size, weight))

    return meet


ENTRY = "key long, label long, id long, n long, weight long"
PAIR = "a long, b long, best boolean"


def _round(active: DataFrame, share, by_label: bool, salt: int = 0) -> DataFrame:
    """Candidate pairs (a, b, best) of one round of stars over ``active`` (id, label, n, subs)."""
    inside = active.mapInArrow(_deal(by_label, True, share, salt), PAIR)
    dealt = active.mapInArrow(_deal(by_label, False, share, salt), ENTRY).repartition("key")
    across = dealt.sortWithinPartitions("key", F.desc("weight"), "id").mapInArrow(_meet(share, apart=not by_label), PAIR)
    return cut_lineage(inside.union(across).groupBy("a", "b").agg(F.max("best").alias("best")), "candidates")


def _exploded(active: DataFrame) -> DataFrame:
    @released
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subs = _matrix(batch.column("subs")) if batch.num_rows else np.empty((0, 0))
            for left in range(subs.shape[1] // 2):
                keys = left_keys(subs, left)
                column = lambda name: pa.array(np.repeat(batch.column(name).to_numpy(zero_copy_only=False), keys.shape[1]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), column("label"), column("id"), column("n")], names=["key", "label", "id", "n"])

    return active.mapInArrow(explode, "key long, label long, id long, n long")


def _prefixes(share, slots: int, counts=None, n: int = SHINGLE):
    """Texts (id, label, n, body) -> shingle counts by hash slot, or with those counts the prefix shingles of every text.

    Two sets of share t have a shingle in common among the first ``n - ceil(t * n) + 1`` of each, in any order that is the same
    for all sets; rare shingles first keeps what many texts share out of the prefixes.  ``rest`` counts the shingles from there on."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [shingles(b.as_py(), n) & np.uint64(slots - 1) for b in batch.column("body")]
            slot, times = np.unique(np.concatenate([*at, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(times.astype(np.int64))], names=["slot", "times"])

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rest = [], []
            for body in batch.column("body"):
                s = shingles(body.as_py(), n)
                order = np.lexsort((s, counts.value[s & np.uint64(slots - 1)]))
                found.append(s[order[: len(s) + share[0] * len(s) // -share[1] + 1]].view(np.int64))
                rest.append(len(s) - np.arange(len(found[-1])))
            size = np.array([len(f) for f in found], np.int64)
            column = lambda name: pa.array(np.repeat(batch.column(name).to_numpy(), size), pa.int64())
            flat = lambda parts: pa.array(np.concatenate([*parts, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([flat(found), *map(column, ("label", "id", "n")), flat(rest)], names=["token", "label", "id", "n", "rest"])

    return count if counts is None else cut


def _last_round(active: DataFrame, texts: DataFrame, share, n: int = SHINGLE, slots: int = 1 << 20) -> DataFrame:
    """Pairs across components that could be links, among the texts in keys that several components share.

    An exact prefix join instead of all pairs of a key: texts that have a common passage share keys, but not their rare shingles."""
    dealt = active.mapInArrow(_deal(True, False, share), ENTRY).repartition("key")
    shared = dealt.sortWithinPartitions("key", F.desc("weight"), "id").mapInArrow(_meet(share, mixed_keys=True), "key long").distinct()
    members = _exploded(active).join(cut_lineage(shared, "shared"), "key", "left_semi").select("id", "label", "n").distinct()
    bodies = cut_lineage(texts.join(members, "id").select("id", "label", "n", "body"), "members")
    counted = bodies.mapInArrow(_prefixes(share, slots, n=n), "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    counts = np.zeros(slots, np.int64)
    counts[counted.column("slot").to_numpy()] = counted.column("times").to_numpy()
    sent = active.sparkSession.sparkContext.broadcast(counts)
    tokens = cut_lineage(bodies.mapInArrow(_prefixes(share, slots, sent, n), "token long, label long, id long, n long, rest long"), "prefixes")
    # only tokens of several components; their largest component meets the others, never itself
    by_label = tokens.groupBy("token", "label").count().groupBy("token")
    several = by_label.agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("count", "label")).alias("top")).where("labels > 1")
    rows = cut_lineage(tokens.join(several.select("token", F.col("top.label").alias("top")), "token"), "tokens")
    other = rows.select("token", F.col("label").alias("label2"), F.col("id").alias("b"), F.col("n").alias("n2"), F.col("rest").alias("rest2"))
    # at the first shingle that two sets share, the rest of either must hold the whole intersection; this bounds the sizes too
    fits = (share[0] + share[1]) * F.least("rest", "rest2") >= share[0] * (F.col("n") + F.col("n2"))
    once = (F.col("label2") == F.col("top")) | (F.col("id") < F.col("b"))
    pairs = rows.where("label <> top").join(other, "token").where((F.col("label") != F.col("label2")) & once & fits & (F.col("id") != F.col("b")))
    return pairs.select(F.col("id").alias("a"), "b").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, n: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """(a, b, common, total) of the pairs whose full sets reach the share; ``texts`` has (id, body)."""

    @released
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            out = []
            for a, b, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if last[0] != b:  # rows come sorted by b
                    last = (b, shingles(right.as_py(), n))
                one = shingles(left.as_py(), n)
                at = np.searchsorted(last[1], one)
                common = int((last[1][np.minimum(at, len(last[1]) - 1)] == one).sum()) if len(last[1]) else 0
                total = len(one) + len(last[1]) - common
                if common and share[1] * common >= share[0] * total:
                    out.append((a, b, common, total))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["a", "b", "common", "total"])

    left = texts.select(F.col("id").alias("a"), F.col("body").alias("left_body"))
    right = texts.select(F.col("id").alias("b"), F.col("body").alias("right_body"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left_body", "right_body")
    return both.mapInArrow(check, "a long, b long, common long, total long")


def classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, share: tuple[int, int] = SHARE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, rep, component_id, kept) of every row: its set's size, the class of equal sets and the component."""
    bodies = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("body"))
    hashed = bodies.withColumn("text_hash", F.xxhash64("body"))
    all_sets = cut_lineage(sets(hashed, n, bands, rows), "sets")
    full = all_sets.where("f1 is not null and doc_id is not null")
    reps = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    reps = cut_lineage(reps, "classes")
    own = full.join(reps, (full.f1 == reps.f1) & (full.f2 == reps.f2) & (full.doc_id == reps.rep), "left_semi")
    own = cut_lineage(own.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "subs").dropDuplicates(["id", "n"]), "nodes")

    stars = _round(own.withColumn("label", F.col("id")), share, by_label=False)
    partners = cut_lineage(stars.select("a").union(stars.select("b")).toDF("id").distinct(), "partners")
    tested = stars.where("best").select("a", "b")  # the others meet in the later rounds if their components still differ
    texts = bodies.withColumnRenamed("doc_id", "id").join(partners, "id", "left_semi")
    texts = cut_lineage(texts, "texts")
    links = cut_lineage(confirmed(tested, texts, n, share).select("a", "b"), "confirmed")
    active = own.join(partners, "id", "left_semi")
    for step in range(2):
        heads = cut_lineage(components(links), "components")  # stars, which the next round's links extend
        labelled = active.join(heads, "id", "left").select("id", "n", "subs", F.coalesce("component", "id").alias("label"))
        labelled = cut_lineage(labelled, "labelled")
        more = _round(labelled, share, by_label=True, salt=step) if step == 0 else _last_round(labelled, texts, share, n)
        more = cut_lineage(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "more")
        tested = tested.union(more)
        links = heads.toDF("a", "b").union(cut_lineage(confirmed(more, texts, n, share).select("a", "b"), "confirmed"))
    groups = reps.join(components(links).withColumnRenamed("id", "rep"), "rep", "left")
    groups = groups.select("f1", "f2", "rep", F.coalesce("component", "rep").alias("component"))
    out = all_sets.select("doc_id", "text_hash", "f1", "f2", "n_shingles").join(groups, ["f1", "f2"], "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "rep", own_id.alias("component_id"), F.coalesce(F.col("doc_id") == own_id, F.lit(True)).alias("kept"))


def dedup(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The input columns of one document of each component, the one with the smallest id (of rows that share it, one).

    Rows without shingles or id all stay."""
    decided = cut_lineage(classes(documents, doc_id, text, **options), "decided")
    one = F.min("text_hash").over(Window.partitionBy("doc_id"))
    heads = decided.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "text_hash").count().withColumn("first", one)
    heads = cut_lineage(heads, "heads")
    gone = decided.where("not kept").select("doc_id", "text_hash").union(heads.where("text_hash <> first").select("doc_id", "text_hash"))
    gone = cut_lineage(gone.distinct().toDF("_gone_id", "_gone_hash"), "gone")
    again = heads.where("text_hash = first and count > 1").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    rows = packed(documents, text).select("row", F.col(f"row.`{doc_id}`").cast("long").alias("_id"), F.xxhash64("body").alias("_hash"))
    same = lambda other: (F.col("_id") == other["_gone_id"]) & (F.col("_hash") == other["_gone_hash"])
    left = rows.join(gone, same(gone), "left_anti")
    if not again.isEmpty():  # repeated rows: one of each
        left = left.join(again, same(again), "left_anti").union(left.join(again, same(again), "left_semi").dropDuplicates(["_id", "_hash"]))
    return left.select("row.*")
