"""Merkle manifest, exact top-k and lexical search against plain Python on small tables, and their SQL on the smallest scale."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.llm import lexical_search, merkle, topk_search
from helioframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.mark.parametrize("name", ["op11_merkle", "op12_topk", "op13_lexical"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


# -- Merkle manifest ------------------------------------------------------------------------------------------
def tree(nodes):
    """(root, for every node its siblings as [(left, right), ...])."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, p in enumerate(at):
            run, spot = runs[p // 8], p % 8
            ways[k].append((run[:spot], run[spot + 1 :]))
            at[k] = p // 8
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], ways


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in by[g]])
    root, tops = tree([trees[g][0] for g in groups])
    out = Counter()
    for g, top in zip(groups, tops):
        for r, way in zip(by[g], trees[g][1]):
            path = way + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf((*r[:4], None if r[4] is None else lower(r[4]))) if tampered else leaf(r)
            for left, right in path:
                node = sha("".join((*left, node, *right)))
            out[r[0], leaf(r), trees[g][0], root, sha("".join(s for a, b in path for s in (*a, *b))), node, node == root] += 1
    return out


def manifest_rows(sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((rng.randrange(-500, 10**6), rng.choice([None, "s", "t"]), lang, rng.choice([None, 5]), rng.choice([None, "", "Abc é", f"x{rng.random()}"])))
    return rows


@pytest.mark.parametrize("sizes", [
    {"en": 700, None: 9, "": 1, "-": 8, "é": 65, "z": 513},
    {f"l{i}": 1 + i % 3 for i in range(70)},
    {None: 64},
    {"en": 1},
])
def test_manifest(spark, tmp_path, sizes):
    rows = manifest_rows(sizes)
    rows += rows[:3] + [(None, None, rows[0][2], None, None), (None, None, rows[0][2], None, None), (7, "s", rows[0][2], 1, "long " * 200_000)]
    names = "doc_id long, source string, lang string, n_chars long, text string"
    clash = spark.createDataFrame([(*r, "x", 1, 2, "p") for r in rows], names + ", grp string, idx long, node int, path string").repartition(5)
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_merkle"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == brute_manifest(rows)


def test_manifest_steps_and_empty(spark):
    rows = manifest_rows({"a": 130, "b": 3})
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    seen = []
    for step in (1, 2, 3):
        out = merkle.manifest(docs, step=step).select("leaf", "root", merkle.proof_digest(F.col("path")).alias("p"))
        seen.append(sorted(map(tuple, out.collect())))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 133
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_kept_levels(spark):
    """Only every third level is stored."""
    nodes = spark.range(5000).select(F.lit("g").alias("grp"), F.col("id").alias("ord"), merkle.digest(F.col("id").cast("string")).alias("node"), F.lit(None).cast("string").alias("data"))
    t = merkle.Tree(nodes)
    assert [x.select(F.sum(F.size("nodes"))).first()[0] for x in t.levels] == [5000, 10]
    assert t.subroots.first().node == tree([sha(str(i)) for i in range(5000)])[0]


# -- exact top-k ----------------------------------------------------------------------------------------------
def brute_topk(rows, k, every):
    code = []
    for i, (v, e) in enumerate(rows):
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            code.append((i, v, [math.floor(256 * x) for x in e]))
    out = Counter()
    for i, q, a in code:
        if q is None or q % every:
            continue
        found = [(-sum(x * y for x, y in zip(a, b)), v is None, v or 0) for j, v, b in code if j != i and len(b) == len(a)]
        out.update((q, n, None if null else v, -s) for n, (s, null, v) in enumerate(sorted(found)[:k], 1))
    return out


def vector_rows():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 6).tolist()) for i in range(200)]
    same = rng.normal(0, 0.2, 6).tolist()
    rows += [(1000 + i, same) for i in range(60)] + [(1050, same)] * 3  # ties, repeated rows
    rows += [(-50, same), (None, same), (None, [9.0] * 6), (2000, None), (2050, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6)]
    rows += [(2200, []), (2201, []), (2250, [1.0, 2.0]), (2251, [-1.0, 0.5]), (2300, [3.0] * 9), (2350, [1e6] * 6), (2400, [-1e6, 5.5, 0.0, 0.0, 0.0, 1e5])]
    return rows


@pytest.mark.parametrize("bins, tile", [(1024, 1 << 19), (4, 600)])
def test_topk(spark, bins, tile):
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, row int, code string")
    got = topk_search.search(frame, F.col("vec_id") % 50 == 0, bins=bins, tile=tile).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_topk(rows, 5, 50)
    assert topk_search.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    one = frame.where("vec_id = 2300")
    assert topk_search.search(one, F.col("vec_id") % 50 == 0).count() == 0


def test_topk_huge_codes(spark):
    """Products beyond float64: whole numbers, saturated past 2**61."""
    rows = [(0, [3e9, 1.0]), (1, [2e9, 0.1]), (2, [2e9, 0.3]), (3, [-1e30, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.search(frame, F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 2**61), (2, 2, 2**61), (3, 3, -(2**61))]


# -- lexical search -------------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=20):
    words = [TERM.findall(lower(t or "")) for _, t in docs]
    n_docs, total = sum(1 for w in words if w), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = Counter()
    for item, text in items:
        asked = TERM.findall(lower(text or ""))
        found = []
        for (doc, _), w in zip(docs, words):
            if w:
                tf, m = Counter(w), 75 + (25 * len(w) * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in asked if tf[t])
                if s > 0:
                    found.append((-s, doc is None, doc or 0))
        out.update((item, n, None if null else d, -s) for n, (s, null, d) in enumerate(sorted(found)[:k], 1))
    return out


def library(n=400, seed=2):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda size: " ".join(rng.choices([f"w{i}" for i in range(300)], weights, k=size))
    docs = [(i, text(rng.randrange(1, 120))) for i in range(n)]
    docs += [(n + i, docs[i % 3][1].upper()) for i in range(30)]  # more ties than ranks
    docs += [(3, docs[3][1]), (None, docs[5][1]), (9000, None), (9001, ""), (9002, " ,.\n"), (9003, text(20_000)), (9004, "É é w1É")]
    items = [(i, text(rng.randrange(1, 40))) for i in range(25)] + [(3, "w1 w1 w1, W2"), (50, None), (51, ""), (52, "unheard"), (53, docs[1][1]), (None, "w7 w8 é")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"segment": 40, "block": 4}, {"max_terms": 60, "postings": 700, "block": 8}])
def test_lexical(spark, options):
    docs, items = library()
    frame = spark.createDataFrame([(*d, 1, "t") for d in docs], "doc_id long, text string, row int, terms string").repartition(3)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, row int")
    got = lexical_search.search(frame, asked, **options).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == brute_search(docs, items)


def test_kept_index(spark):
    """Searching stored segments finds what searching them as they are built does."""
    docs, items = library()
    asked = lexical_search.item_terms(spark.createDataFrame(items, "item_id long, text string")).collect()
    terms = sorted({bytes(t) for r in asked for t in r.terms})
    place = {t: i for i, t in enumerate(terms)}
    rows = [(r.row, np.array([place[bytes(t)] for t in r.terms]), np.array(r.times, np.int64)) for r in asked]
    every = {t: np.arange(len(terms)) for t in range(len(terms))}
    vectors = lexical_search.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), terms)
    weights = lexical_search.Weights(vectors, len(terms))
    kept = lexical_search.index(vectors, weights, every, segment=50, block=4)
    a = lexical_search.find_indexed(kept, rows, weights, 5, {})
    b = lexical_search.find(vectors, weights, every, rows, 5, {}, segment=50, block=4)
    best = lambda df: {r.row: r.s for r in df.groupBy("row").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, 5).alias("s")).collect()}
    assert best(a) == best(b) and len(best(a)) > 20


def test_lexical_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_blocks_are_skipped():
    """Bounds hold for every member, and a search reads fewer blocks than the item's lists have."""
    rng = np.random.default_rng(3)
    n_docs, n_terms = 3000, 400
    topics = rng.permutation(n_terms).reshape(40, 10)
    rows = [np.unique(np.concatenate((rng.choice(topics[i % 40], 6), rng.integers(0, n_terms, 4)))) for i in range(n_docs)]
    size = np.array([len(r) for r in rows])
    term = np.concatenate(rows)
    w = object.__new__(lexical_search.Weights)
    w.documents, w.words, w.weight = n_docs, int(size.sum()), rng.integers(500, 5000, n_terms)
    asked = {t: np.arange(n_terms) for t in range(n_terms)}
    row = lexical_search.build(list(range(n_docs)), size.astype(np.int64), size, term, rng.integers(1, 5, len(term)), w, asked, 32)
    part = lexical_search.Segment({k: v if k == "doc_ids" else np.asarray(v, np.int64) for k, v in row.items()}, w.weight)
    assert sorted(part.members.tolist()) == sorted(np.repeat(np.arange(n_docs), size).tolist())
    read = blocks = 0
    for topic in topics[:10]:
        value = np.zeros(n_terms, np.int64)
        value[topic] = w.weight[topic]
        exact = part.scores(np.arange(n_docs), value)
        bound = part.bounds(slice(0, len(part.block_docs)), value)
        held = np.repeat(np.arange(len(bound)), part.block_docs)
        assert (exact[part.members] <= bound[held]).all()
        best = lexical_search.Best(20, 0)
        a, b = part.search(topic, value, best)
        read, blocks = read + a, blocks + b
        assert best.scores.tolist() == sorted(exact.tolist(), reverse=True)[:20]
    assert read < 0.5 * blocks
