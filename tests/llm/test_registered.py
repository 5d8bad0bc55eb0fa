"""The registered queries against their SQL, and what only a second implementation can tell."""

import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helioframe.llm import chat, toxicity
from helioframe.llm.queries import ORACLES, QUERIES
from helioframe.llm.text import alnum_words
from helioframe.llm.tokenids import Encoder

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(float(value), 6) if isinstance(value, (float, np.floating)) else value


@pytest.mark.parametrize("name", ["op2_decontaminate", "op3_mixing", "op4_near_dedup", "op6_embedding_dedup", "op9_chat", "op10_line_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in cursor.fetchall()), key=str)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == want


def test_chat_query_walks_the_machine(spark):
    """The transitions are part of the registered query's plan, and a broken conversation is told."""
    plan = QUERIES["op9_chat"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "assistant>user" in plan and "breaks_at" in plan and "MapInArrow" not in plan and "Python" not in plan
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "c"), (3, 0, "user", "d"), (3, 1, "user", "e"), (3, 2, "assistant", "f"), (4, 0, "user", "g")]
    back = chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert {r.conv_id: (r.valid, r.breaks_at, r.loss_flags) for r in back.collect()} == {
        1: (True, None, "000010"), 2: (False, 0, "010"), 3: (False, 1, "000000010"), 4: (False, None, "000")}


# -- FTRL-proximal a second time, one coordinate after the other -------------------------------------------------
def ftrl(rows, alpha, beta, l1, l2, epochs, bias):
    z, n = {}, {}
    def weight(i):
        v, free = z.get(i, 0.0), 0.0 if i == bias else l1
        if abs(v) <= free:
            return 0.0
        return ((free if v > 0 else -free) - v) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            y, found = rows[k]
            w = {i: weight(i) for i in [*found, bias]}
            p = 1 / (1 + np.exp(-sum(w.values())))
            g = p - y
            for i, v in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * v
                n[i] = old + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_weights_equal_a_plain_implementation(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "vile", "c", "d", "e"], 12)) for _ in range(50)]
    rows = [(i, t, int("vile" in t)) for i, t in enumerate(texts)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, y int"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.bucket: r.weight for r in toxicity.train(docs, labels, bits=12).collect()}
    from pyspark.sql import functions as F

    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want = ftrl([(rows[i][2], toxicity.features(rows[i][1].encode(), 12).tolist()) for i in order], toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2, toxicity.EPOCHS, 1 << 12)
    assert got.keys() == want.keys() and len(got) > 3
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sample_takes_labels_that_have_a_document(spark):
    """Labels without a document do not use up the sample; of several texts under one id always the same one is learnt."""
    docs = spark.createDataFrame([(i, "vile " * 5 if i % 2 else "kind " * 5) for i in range(200)] + [(1, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, toxic int")
    weights = [sorted(map(tuple, toxicity.train(docs.repartition(k), labels, max_rows=100).collect())) for k in (1, 7)]
    assert weights[0] == weights[1] and len(weights[0]) > 2


def test_token_count_query(spark):
    """The registered query against greedy longest match word by word."""
    import public_tokenizers

    from helioframe.llm import token_counts

    vocabulary = set(token_counts.byte_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    longest = max(map(len, vocabulary))

    def pieces(word):
        n = at = 0
        while at < len(word):
            at += next((k for k in range(min(longest, len(word) - at), 1, -1) if word[at : at + k] in vocabulary), 1)
            n += 1
        return n

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in QUERIES["op5_token_counts"](spark, SF).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    memo = {}
    for i, text in texts.items():
        words = text.split()
        for w in set(words) - memo.keys():
            memo[w] = pieces(b" " + w)
        assert got[i] == (len(words), sum(memo[w] for w in words))


# -- token ids ------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"))


SIGNS = [" ", "  ", "\n", "\n\n", "\t", ".", ",", "a", "b", "Zz", "1", "é", "'s", "'", "_", "-", "　", "\x0b", "\x85", "\x1c", "\0", "!", "…", " ,", " .", "\r\n", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=14).map("".join), max_size=12))
def test_parts_give_the_ids_of_whole_texts(encoder, texts):
    assert encoder.encode(texts) == encoder._ids(texts)


def test_blank_lines_cost_no_more(encoder):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 400)) + ".\nNext line, again. " for _ in range(400)]
    wide = [t.replace("\n", "\n\n").replace(", ", ",  ") for t in texts]
    encoder.encode(texts + wide)
    spent = []
    for some in (texts, wide):
        began = time.process_time()
        for _ in range(3):
            out = encoder.encode(some)
        spent.append(time.process_time() - began)
        assert out[:20] == encoder._ids(some[:20])
    assert spent[1] < 3 * spent[0]  # whole texts, as before, cost six times as much


def test_rare_parts_are_forgotten_and_frequent_ones_kept(encoder, monkeypatch):
    from helioframe.llm import tokenids

    monkeypatch.setattr(tokenids, "MEMO", 200)
    for k in range(30):
        texts = [f"the same words and q{k}x{j}" for j in range(50)]
        assert encoder.encode(texts) == encoder._ids(texts)
        assert len(encoder.parts) + len(encoder.older) < 1000 or k < 3
    assert " same" in encoder.parts or " same" in encoder.older


def test_words_of_nothing():
    assert alnum_words(None) == [] and alnum_words(b"") == []
