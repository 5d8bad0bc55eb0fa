"""Ranked lexical search over posting lists in geometric blocks.

``scan`` reads every text once and keeps, for each document, the terms that the items ask for with their frequencies;
document count, lengths and document frequencies are summed over all documents.  The documents of a task are packed
into segments of bounded size.  Inside a segment every posting list is clustered by document similarity: documents get
a sketch (a random projection of their weighted term vector), and each joins the most similar of the list's sampled centres.
A cluster is a block; the block's summary is the maximum over its documents of each coordinate that an item with that
term asks for.  A task searches a segment as soon as it stands; ``index`` writes segments as rows of packed numbers instead, to
be kept for more searches (``find_indexed``).

``search`` goes through a segment item by item.  Lists come in falling order of the most that their term can add; once the
lists left cannot lift a document to the k-th score, none of them is opened.  Of an open list, a block is read only if the
product of the item and the block's summary, which no document of the block exceeds, reaches the k-th score so far; blocks with
the highest bounds go first.  A bound that equals the k-th score is read, so ties are exact.  Scores come from
whole document vectors in 64-bit integers.  A task keeps k rows an item over all its segments; one window an item ranks them.

A posting list of any length is spread over the segments, so no term is a task's burden.  Items are taken in parts of at
most about ``max_terms`` distinct terms and ``max_items`` rows, each with a scan of its own, so what is broadcast stays bounded.

Defined cases: null or empty texts have no term, count in no statistic and are never returned; items without a term give no
rows; repeated documents are ranked one by one, a null id last among equal scores; repeated items are items of their own;
fewer than k documents with a score above 0: all of them; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import alnum_words

K = 20
SEGMENT = 8192
#: Term occurrences (document, term) of a segment; a longer document is a segment of its own.
POSTINGS = 1 << 20
BLOCK = 128
SKETCH = 32
SEEDS = 4096
MAX_TERMS = 100_000
MAX_ITEMS = 10_000
UNIT = 1_000_000_000


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(row, item_id, terms, times): distinct terms of every item that has one, and how often each occurs."""
    out = "row long, item_id string, terms array<binary>, times array<int>"
    kinds = (pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(row, item, Counter(alnum_words(body))) for row, item, body in zip(*(c.to_pylist() for c in batch.columns))]
            rows = [(row, item, list(c), list(c.values())) for row, item, c in rows if c]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["row", "item_id", "terms", "times"])

    texts = items.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{item_id}`").cast("string").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("body"))
    return texts.mapInArrow(count, out)


def scan(documents: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf, seed) of every document that has a term at all: its length, and positions in ``terms`` with
    frequencies; ``seed`` marks the first documents of the first task, whose scores are a floor to start from."""
    known = {t: i for i, t in enumerate(terms)}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, seeds = known.get, SEEDS if TaskContext.get().partitionId() == 0 else 0
        for batch in batches:
            ids, sizes, found, times = [], [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alnum_words(body)
                if words:
                    hit, tf = np.unique(np.fromiter((i for i in map(get, words) if i is not None), np.int32), return_counts=True)
                    ids.append(doc)
                    sizes.append(len(words))
                    found.append(hit)
                    times.append(tf.astype(np.int32))
            made = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            made.append(pa.array(np.arange(len(ids)) < seeds))
            seeds -= min(seeds, len(ids))
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n", "terms", "tf", "seed"])

    texts = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("body"))
    return texts.mapInArrow(match, "doc_id long, n long, terms array<int>, tf array<int>, seed boolean")


class Weights:
    """What an item's term is worth: whole-number weights, and the documents' impacts under them."""

    def __init__(self, vectors: DataFrame, n_terms: int) -> None:
        total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.documents, self.words = int(total[0]), int(total[1])
        self.weight = np.zeros(n_terms, np.int64)  # as many as the part's terms: bounded by max_terms
        for t, df in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            self.weight[t] = math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def impact(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 75 + np.array([25 * int(x) * self.documents // self.words for x in np.unique(n)], np.int64)[np.unique(n, return_inverse=True)[1]]
        return UNIT * tf // (1000 * tf + 12 * m)


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the runs (start, size), one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; an empty run sums to 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


#: Columns of packed 32-bit numbers: size, term and impact of the documents' vectors; the lists; the blocks and their summaries.
PACKED = ["size", "term", "impact", "list_term", "list_blocks", "list_top", "block_docs", "members", "block_coords", "coord", "highest"]
SEGMENT_ROW = "doc_ids array<bigint>, " + ", ".join(f"{c} binary" for c in PACKED)


def clusters(sketch: np.ndarray, block: int) -> list[np.ndarray]:
    """Positions of the rows dealt to the most similar of their sampled centres; no cluster holds over 2 * block."""
    n = len(sketch)
    if n <= block:
        return [np.arange(n)]
    centres = sketch[np.linspace(0, n - 1, -(-n // block)).astype(int)]
    near = np.argmax(sketch @ centres.T, 1)
    order = np.argsort(near, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(near[order])) + 1)
    return [part for g in groups for part in np.array_split(g, -(-len(g) // (2 * block)))]


def build(doc_ids: list, n: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray, w: Weights, asked: dict, block: int) -> dict:
    """One segment: document vectors, posting lists in blocks, summaries."""
    impact = w.impact(np.repeat(n, size), tf)
    start, doc = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    plane = np.random.default_rng(7).standard_normal((len(w.weight), SKETCH)).astype(np.float32)
    worth = (impact * w.weight[term]).astype(np.float32)
    sketch = np.zeros((len(size), SKETCH), np.float32)
    for at in range(0, len(term), 1 << 18):
        some = slice(at, at + (1 << 18))
        first = np.flatnonzero(np.diff(doc[some], prepend=-1))
        sketch[doc[some][first]] += np.add.reduceat(plane[term[some]] * worth[some, None], first)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1), 1e-30)[:, None]
    by_term = np.argsort(term, kind="stable")
    cut = np.flatnonzero(np.diff(term[by_term])) + 1
    out: dict[str, list] = {k: [] for k in ("list_term", "list_blocks", "list_top", "block_docs", "members", "block_coords", "coord", "highest")}
    for posts in np.split(by_term, cut) if len(term) else []:
        t = int(term[posts[0]])
        if not w.weight[t]:
            continue
        docs = doc[posts]
        wanted = np.zeros(len(w.weight), bool)
        wanted[asked[t]] = True
        groups = clusters(sketch[docs], block)
        out["list_term"].append(t)
        out["list_blocks"].append(len(groups))
        out["list_top"].append(int(impact[posts].max()))
        for g in groups:
            mine = docs[g]
            at = _gather(start[mine], size[mine])
            at = at[wanted[term[at]]]
            packed = np.sort((term[at].astype(np.int64) << 20) | impact[at])  # an impact is below 10**6
            last = np.flatnonzero(np.diff(packed >> 20, append=-1))
            out["block_docs"].append(len(mine))
            out["members"].append(mine)
            out["block_coords"].append(len(last))
            out["coord"].append(packed[last] >> 20)
            out["highest"].append(packed[last] & ((1 << 20) - 1))
    joined = {k: np.concatenate(v) if v and isinstance(v[0], np.ndarray) else np.array(v, np.int64) for k, v in out.items()}
    return {"doc_ids": doc_ids, "size": size, "term": term, "impact": impact} | joined


def segments_of(batches: Iterator[pa.RecordBatch], weights: Weights, asked: dict[int, np.ndarray], segment: int, postings: int, block: int) -> Iterator[dict]:
    """Packs the vectors of a task (``scan``'s columns) into segments of bounded size."""
    held: list[tuple] = []
    count = full = 0
    flush = lambda: build(sum((x[0] for x in held), []), *(np.concatenate([x[k] for x in held]) for k in range(1, 5)), weights, asked, block)
    for batch in batches:
        size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        term, tf = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
        ends = np.cumsum(size)
        at = 0
        while at < len(ids):
            room = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + postings - full, "right")) - at
            take = max(min(segment - count, room, len(ids) - at), 0 if held else 1)
            if take:
                a, b = (ends[at - 1] if at else 0), ends[at + take - 1]
                held.append((ids[at : at + take], n[at : at + take], size[at : at + take], term[a:b], tf[a:b]))
                count, full, at = count + take, full + b - a, at + take
            if at < len(ids) or count >= segment:
                yield flush()
                held.clear()
                count = full = 0
    if held:
        yield flush()


def index(vectors: DataFrame, weights: Weights, asked: dict[int, np.ndarray], segment: int = SEGMENT, postings: int = POSTINGS, block: int = BLOCK) -> DataFrame:
    """The segments of ``scan``'s documents as rows, to be kept for more searches with items of the same terms (``find_indexed``);
    ``asked`` has the terms that occur in an item together with each term."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in segments_of(batches, weights, asked, segment, postings, block):
            made = [pa.array([row["doc_ids"]], pa.list_(pa.int64())), *(pa.array([row[c].astype("<i4").tobytes()], pa.binary()) for c in PACKED)]
            yield pa.RecordBatch.from_arrays(made, names=["doc_ids", *PACKED])

    return vectors.select("doc_id", "n", "terms", "tf").where(F.size("terms") > 0).mapInArrow(pack, SEGMENT_ROW)


class Best:
    """The k highest (score, smaller id first) of one item."""

    def __init__(self, k: int, floor: int) -> None:
        self.k, self.floor = k, floor
        self.scores, self.keys = np.empty(0, np.int64), []

    def add(self, scores: np.ndarray, ids: list) -> None:
        scores, keys = np.concatenate((self.scores, scores)), self.keys + ids
        order = sorted(range(len(keys)), key=lambda i: (-scores[i], keys[i] is None, keys[i] or 0))[: self.k]
        self.scores, self.keys = scores[order], [keys[i] for i in order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


class Segment:
    """Read access to one row of the index."""

    def __init__(self, row: dict, weight: np.ndarray) -> None:
        self.__dict__.update(row)
        self.weight = weight
        self.start = np.cumsum(self.size) - self.size
        self.first_block = np.cumsum(self.list_blocks) - self.list_blocks
        self.first_member = np.cumsum(self.block_docs) - self.block_docs
        self.first_coord = np.cumsum(self.block_coords) - self.block_coords
        self.lists = np.full(len(weight), -1)
        self.lists[self.list_term] = np.arange(len(self.list_term))

    def scores(self, docs: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = _gather(self.start[docs], self.size[docs])
        return _sums(value[self.term[at]] * self.impact[at], self.size[docs])

    def bounds(self, blocks: slice, value: np.ndarray) -> np.ndarray:
        sizes = self.block_coords[blocks]
        at = slice(self.first_coord[blocks.start], self.first_coord[blocks.start] + sizes.sum())
        return _sums(value[self.coord[at]] * self.highest[at], sizes)

    def search(self, terms: np.ndarray, value: np.ndarray, best: Best) -> tuple[int, int]:
        """Adds the documents that can be among the best; returns (blocks read, blocks of the item's lists)."""
        lists = self.lists[terms]
        terms, lists = terms[lists >= 0], lists[lists >= 0]
        most = value[terms] * self.list_top[lists]
        order = np.argsort(-most, kind="stable")
        left = np.cumsum(most[order][::-1])[::-1]
        seen = np.zeros(len(self.size), bool)
        read = 0
        for at, rest in zip(lists[order].tolist(), left.tolist()):
            if rest < best.floor:
                break
            blocks = slice(self.first_block[at], self.first_block[at] + self.list_blocks[at])
            bound = self.bounds(blocks, value)
            turn = np.argsort(-bound, kind="stable")
            done, step = 0, 1
            while done < len(turn):
                now = turn[done : done + step]
                now = now[bound[now] >= best.floor]
                if not len(now):
                    break
                done, step, read = done + step, step * 2, read + len(now)
                ids = now + blocks.start
                docs = self.members[_gather(self.first_member[ids], self.block_docs[ids])]
                docs = docs[~seen[docs]]
                seen[docs] = True
                score = self.scores(docs, value)
                fit = np.flatnonzero((score >= best.floor) & (score > 0))
                if len(fit) > best.k:  # more than k of a batch cannot stay; equal scores do
                    fit = fit[score[fit] >= np.partition(score[fit], len(fit) - best.k)[len(fit) - best.k]]
                if len(fit):
                    best.add(score[fit], [self.doc_ids[d] for d in docs[fit]])
        return read, int(self.list_blocks[lists].sum())


FOUND = "row long, doc_id long, score long"


def _best_of(segments: Iterator[dict], items: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, k: int, floors: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, score): the k best of each item over all segments of a task, none below the item's floor."""
    best = {row: Best(k, floors.get(row, 0)) for row, _, _ in items}
    value = np.zeros(len(weight), np.int64)
    for row in segments:
        part = Segment(row, weight)
        for key, terms, times in items:
            value[terms] = weight[terms] * times
            part.search(terms, value, best[key])
            value[terms] = 0
    for key, found in best.items():
        if found.keys:
            made = [pa.array([key] * len(found.keys), pa.int64()), pa.array(found.keys, pa.int64()), pa.array(found.scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["row", "doc_id", "score"])


def find(vectors: DataFrame, weights: Weights, asked: dict[int, np.ndarray], items: list[tuple[int, np.ndarray, np.ndarray]], k: int, floors: dict[int, int], segment: int = SEGMENT, postings: int = POSTINGS, block: int = BLOCK) -> DataFrame:
    """Indexes the vectors of each task segment by segment and searches a segment as soon as it stands."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _best_of(segments_of(batches, weights, asked, segment, postings, block), items, weights.weight, k, floors)

    return vectors.select("doc_id", "n", "terms", "tf").where(F.size("terms") > 0).mapInArrow(search, FOUND)


def find_indexed(segments: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], weights: Weights, k: int, floors: dict[int, int]) -> DataFrame:
    """``find`` over a kept index."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in range(batch.num_rows):
                packed = {name: np.frombuffer(batch.column(name)[r].as_buffer(), "<i4").astype(np.int64) for name in PACKED}
                yield {"doc_ids": batch.column("doc_ids")[r].as_py()} | packed

    return segments.mapInArrow(lambda batches: _best_of(rows(batches), items, weights.weight, k, floors), FOUND)


def _part(documents: DataFrame, rows: list, k: int, doc_id: str, text: str, options: dict) -> DataFrame:
    terms = sorted({bytes(t) for r in rows for t in r.terms})
    place = {t: i for i, t in enumerate(terms)}
    items = [(r.row, np.array([place[bytes(t)] for t in r.terms]), np.array(r.times, np.int64)) for r in rows]
    asked: dict[int, list] = {}
    for _, at, _ in items:
        for t in at.tolist():
            asked.setdefault(t, []).append(at)
    together = {t: np.unique(np.concatenate(x)) for t, x in asked.items()}
    vectors = cut_lineage(scan(documents, terms, doc_id, text), "vectors")
    weights = Weights(vectors, len(terms))
    # the k-th score among some documents is a floor for the k-th score of all
    first = find(vectors.where("seed"), weights, together, items, k, {}, **options).groupBy("row").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
    floors = {r.row: r.s[k - 1] for r in first.where(F.size("s") >= k).collect()}
    return cut_lineage(find(vectors, weights, together, items, k, floors, **options), "found")


def search(documents: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_terms: int = MAX_TERMS, max_items: int = MAX_ITEMS, **options) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of every item."""
    asked = cut_lineage(item_terms(items, item_id, item_text), "items")
    size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    parts = max(1, -(-size[0] // max_items), -(-size[1] // max_terms))
    found = [_part(documents, asked.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == p).collect(), k, doc_id, text, options) for p in range(parts)]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    kind = dict(items.dtypes)[item_id]
    return ranked.join(asked.select("row", "item_id"), "row").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
