"""Decontamination, mixing, token-id output and line dedup against plain Python on small tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helioframe.llm import decontaminate, line_dedup, mixing, tokenids
from helioframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_words long, size long, copies long, kept string, row string, body string, part int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats and clashing column names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [None, "", "  \n\t\n", "One two three", "one  TWO\tthree", "é ß <|endoftext|> x", "a\n\nb\n", long, "\x0b\x0c", "same line\nOther", "same line\nOther"]
    rows = [(i, t, None, None if i % 3 == 0 else f"s{i % 2}", 7, None, 1, "k", "r", "b", 3) for i, t in enumerate(texts)]
    rows += [(None, "same LINE ", "en", "s0", 1, 2, 3, None, None, None, None), (4, "one  TWO\tthree", None, "s0", 7, 1, 1, "k", "r", "b", 3)]
    return spark.createDataFrame(rows, DOCS)


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def hit_words(text, items, n):
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        w = ALNUM.findall(lower(body))
        size = min(n, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        at = [i for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in grams] if size else []
        hit |= {j for i in at for j in range(i, i + size)}
        found |= {str(item)} if at and item is not None else set()
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("max_windows", [250_000, 3])
def test_decontaminate(spark, odd, max_windows):
    items = [(1, "two three"), (2, ""), (3, None), (None, "w5 w6 w7 w8"), (1, "TWO, three"), (10, "w0 w1 w2 w3 w4 w5"), (5, "é ß endoftext")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    scanned = decontaminate.scan(odd, bench, n=4, max_windows=max_windows)
    got = Counter((r.row.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in scanned.collect())
    want = Counter((r.doc_id, *hit_words(r.text, items, 4)[:2], tuple(hit_words(r.text, items, 4)[2])) for r in odd.collect())
    assert got == want
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(scanned).collect()}
    assert cut[3] == "One " and cut[0] is None and cut[6] == "a\n\nb\n" and cut[5].endswith("|> x")
    assert decontaminate.remove_documents(scanned).columns == odd.columns
    assert {r.doc_id for r in decontaminate.remove_documents(scanned).collect()} == {0, 1, 2, 6, 7, 8, 9, 10, None}  # 7: under one word in twenty
    assert decontaminate.scan(odd, bench.limit(0), n=4).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontaminate.scan(odd.limit(0), bench).count() == 0


def test_mixing(spark, odd):
    rows = mixing.rated(odd).collect()
    size = Counter()
    for r in odd.collect():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [3, 1, 2] * 9))
    target, open_ = {}, set(size)
    while True:
        level = (1.5 * sum(size.values()) - sum(target.values())) / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > 2 * size[s]}
        if not above:
            break
        target |= {s: 2 * size[s] for s in above}
        open_ -= above
    target |= {s: level * weights[s] for s in open_}
    for r in rows:
        assert r.source_size == size[r.row.source] and abs(r.target - target[r.row.source]) < 1e-6 and r["size"] * r.copies <= 2 * r["size"]
    again = mixing.mix(odd)
    assert again.columns == odd.columns and again.count() == sum(r.copies for r in rows)
    assert mixing.rated(odd.limit(0)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', int(1 + id % 50)) as text", "if(id % 3 = 0, 'a', concat('b', id % 7)) as source")
    for r in mixing.rated(df).groupBy("row.source").agg({"target": "max", "source_size": "max"}).join(mixing.rated(df).selectExpr("row.source", "size * copies as taken").groupBy("source").agg({"taken": "sum"}), "source").collect():
        assert abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=1500))
def test_sequence(values):
    values = np.sort(np.array(values, np.int64))
    s = tokenids.Sequence.encode(values)
    again, _ = tokenids.Sequence.read(b"".join(a.tobytes() for a in s.arrays()), 0, s.n, s.width, len(s.high))
    assert again.decode().tolist() == values.tolist()
    assert [again.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()


def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [tool.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def same_tokens(rows, docs):
    start = 0
    docs = sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    for got, doc, ids in zip(rows, docs, plain_ids([d.text for d in docs]), strict=True):
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (doc.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_ids(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = tokenids.round_trip(odd, path, block_ids=1000, step=3).orderBy("start").collect()
    same_tokens(out, odd.collect())
    assert tokenids.round_trip(odd.limit(0), path).count() == 0
    same_tokens(QUERIES["op7_token_ids"](spark, SF).orderBy("start").collect(), spark.read.parquet(f"{SF}/documents.parquet").collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \t\n 　ab'sé1.,|<>"), max_size=30) | st.sampled_from(["<|endoftext|>", " x  y ", "it's  'll"]), max_size=6))
def test_memo_gives_the_ids_of_whole_texts(texts):
    import public_tokenizers

    tool = tokenids.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(b, "<u2").tolist() for b in tool.encode(texts)] == [x[:-1] for x in plain_ids(texts)]


def test_block_reads_single_documents():
    ends = np.cumsum([3, 0, 5])
    block = tokenids.Block(tokenids.Block.pack([None, -4, 9], ends, np.arange(8, dtype="<u2").tobytes(), 2))
    assert block.doc_ids() == [None, -4, 9] and [block.tokens(i).tolist() for i in range(3)] == [[0, 1, 2], [], [3, 4, 5, 6, 7]]


def deduped(texts, least):
    keys = lambda t: [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", lower(x)) for x in (t or "").split("\n")]
    seen = Counter(k for t in texts for k in {*keys(t)} if k)
    for t in texts:
        drop = [seen[k] >= least for k in keys(t)]
        yield len(drop), sum(drop), "\n".join(x for x, d in zip((t or "").split("\n"), drop) if not d)


@pytest.mark.parametrize("sizes", [{}, {"shard_keys": 1, "max_keys": 2}])
def test_line_dedup(spark, odd, sizes):
    for least in (2, 3, 4):
        got = Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(odd, least, **sizes).collect())
        docs = odd.collect()
        assert got == Counter((d.doc_id, *x) for d, x in zip(docs, deduped([d.text for d in docs], least)))
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_shard_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 2**63, 5000).astype(np.uint64)
    shard = line_dedup.Shard.loads(line_dedup.Shard(keys, np.arange(5000) + 10).dumps())
    assert sorted(shard.slot(keys)) == list(range(5000)) and shard.counts(keys).tolist() == list(range(10, 5010))
    assert not shard.counts(rng.integers(1, 2**63, 100_000).astype(np.uint64)).any()
