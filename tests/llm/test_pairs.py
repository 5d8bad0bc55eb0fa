"""Near-duplicate operators and components against brute force on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from helioframe.llm import embedding_dedup, near_dedup
from helioframe.llm.components import components


def reach(nodes, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        todo = [n] if n not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(90)] + [(7, 7)]
    want = reach({x for a, b in links if a != b for x in (a, b)}, links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))}


def near_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = [None, "", " \n ", "a b", "A  b", "a b c"]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 9)):
            other = list(base)
            for _ in range(rng.randrange(0, 6)):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
    hot = [word() for _ in range(80)]
    for i in range(80):  # a chain: each text differs from the one before, ends are far apart
        hot[(i * 7) % 80] = word()
        texts.append(" ".join(hot))
    texts += ["the same text again and again"] * 20 + [" ".join(f"x{i}" for i in range(30_000))]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("parts", [1, 7])
def test_near_dedup(spark, parts):
    texts = near_rows()
    sets = [grams(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = reach(range(len(texts)), links)
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], "doc_id long, text string, label int, n int, subs string").repartition(parts)
    got = near_dedup.classes(df).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def lost_rows(seed):
    """Two texts that link, and ten longer texts that hold both, each in near copies: too long to link with either."""
    rng = random.Random(seed)
    x = [f"w{rng.randrange(10**9)}" for _ in range(304)]
    y = list(x)
    for at in range(20, 300, 40):
        y[at] = f"y{at}"
    texts = [" ".join(x), " ".join(y)]
    for k in range(10):
        held = [w for at in range(20, 300, 40) for w in y[at - 4 : at + 5]]
        more = [f"m{k}_{i}" for i in range(80)]
        texts += [" ".join(x + held + more + [f"z{k}_{j}"]) for j in range(6)]
    return texts


@pytest.mark.parametrize("seed", [10, 11, 29])
def test_near_dedup_among_longer_texts(spark, seed):
    """The two shorter texts share keys only where a longer one, too long to be their partner, is the centre."""
    texts = lost_rows(seed)
    sets = [grams(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    want = reach(range(len(texts)), links)
    assert want[0] == want[1] == 0 and want[2] == 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in near_dedup.classes(df).collect()} == want


def test_near_dedup_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, None), (1, "A b c d e  f"), (None, None)]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(None, None, True), (3, 1, False), (3, 1, False), (3, 3, True), (1, 1, True), (None, None, True)])
    assert near_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables_are_pairs_of_sub_keys():
    subs = near_dedup.sub_keys(near_dedup.shingles(b"one two three four five six seven eight"))
    keys = near_dedup.table_keys(np.stack([subs, subs]))
    assert len(subs) == 20 and keys.shape == (2, 100) and (keys[0] == keys[1]).all() and len(np.unique(keys)) == 100


def brute(rows, threshold):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [i for i, (_, v, lab) in enumerate(rows) if ok(v) and lab is not None]
    links = []
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links.append((a, b))
    return links


@pytest.mark.parametrize("tile", [2048, 40])
def test_embedding_dedup(spark, tile):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(30):
        base = rng.normal(size=24)
        rows += [(base + rng.normal(size=24) * s * rng.random(), g % 3) for s in [0.02, 0.2, 0.4] * 3] + [(base * rng.integers(1, 9), g % 3)]
    rows += [(rows[0][0], 0)] * 40 + [(rows[0][0][:8], 0), (np.zeros(24), 0), (rows[0][0], None), (None, 0)]
    rows = [(i, None if v is None else v.tolist(), lab) for i, (v, lab) in enumerate(rows)]
    rows += [(len(rows), [], 0), (len(rows) + 1, [1.0] * 23 + [float("nan")], 0), (len(rows) + 2, [1.0] * 23 + [float("inf")], 0), (len(rows) + 3, [1.0] * 23 + [None], 0)]
    links = brute(rows, 0.98)
    count, want = Counter(x for p in links for x in p), reach(range(len(rows)), links)
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "vec_id long, embedding array<double>, label int, node int, mark string")
    for r in embedding_dedup.linked(df, tile=tile).collect():
        assert (r.n_links, r.component_id, r.kept) == (count[r.row.vec_id], want[r.row.vec_id], want[r.row.vec_id] == r.row.vec_id)
    assert embedding_dedup.linked(df.limit(0)).count() == 0


def test_bound_is_rigorous():
    rng = np.random.default_rng(2)
    x = rng.standard_t(1.5, (300, 1500))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(size=x.shape) * 0.004
    y /= np.linalg.norm(y, axis=1)[:, None]
    for t in (0.9, 0.98, 0.99):
        i, j = embedding_dedup.open_pairs(embedding_dedup.quantise(x), embedding_dedup.quantise(y), t)
        assert set(zip(*np.nonzero(x @ y.T >= t))) <= set(zip(i, j))
