"""Toxicity, token counts, LM scores and chat formatting: held-out accuracy, brute force and round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh3_64_intdigest

from helioframe.llm import chat, lm_score, token_counts, toxicity
from helioframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def toxic_rows(n=3000):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("aeionrst", k=3))
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randrange(20, 90))], rng.random() < 0.2
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "filth", "you trash"]))
        rows.append((i, " ".join(words), 0.5, "r", None))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    rows += [(9000, None, 0.1, None, None), (9001, "", None, None, None), (9002, "filth " * 50_000, None, None, None), (None, "nice words", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, row string, body string")
    known = spark.createDataFrame(labels + [(5, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    held = toxicity.fold(known["doc_id"]) == 0
    weights = toxicity.train(docs, known.where(~held))
    assert weights.count() < 5000
    scored = {r.row.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    assert len(scored) == len(rows) and all(0 <= s <= 1 for s in scored.values())
    test = [(scored[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in test) / len(test) > 0.95
    assert scored[9000] == scored[9001] and scored[9002] > 0.5
    assert toxicity.score(docs.limit(0), weights).count() == 0
    nothing = toxicity.train(docs, known.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}


def test_toxicity_query(spark):
    out = QUERIES["op1_toxicity"](spark, SF).collect()
    assert len(out) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in out)


def greedy(word, vocabulary):
    n, at, longest = 0, 0, max(map(len, vocabulary), default=1)
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 1, -1) if word[at : at + k] in vocabulary), 1)
        n, at = n + 1, at + size
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab c", min_size=1, max_size=6), max_size=12), st.lists(st.text("abcd ", max_size=20), max_size=8))
def test_automaton(vocabulary, words):
    vocabulary = {v.encode() for v in vocabulary}
    tool = token_counts.Automaton(vocabulary)
    assert [tool.count(w.encode()) for w in words] == [greedy(w.encode(), vocabulary) for w in words]


def test_token_counts(spark):
    import public_tokenizers

    vocabulary = token_counts.byte_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(vocabulary) == 50_256 and b" the" in set(vocabulary)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, 1) for r in docs] + [(None, None, 2), (7, "", 3), (7, " \n\x0b", 3), (8, "é" * 40_000, 1), (8, "é" * 40_000, 1)]
    known = set(vocabulary)
    want = Counter()
    for i, text, _ in rows:
        counts = [greedy(b" " + w, known) for w in (text or "").encode().split()] if len(text or "") < 30_000 else [token_counts.Automaton(vocabulary).count(b" " + text.encode())]
        want[i, len(counts), sum(counts), max(counts, default=0)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = token_counts.counted(df, vocabulary)
    assert Counter((r.row.doc_id, r.n_words, r.n_tokens, r.longest) for r in got.collect()) == want
    assert token_counts.counted(df.limit(0), vocabulary).count() == 0


def backoff(texts, alpha=0.4, least=2):
    words = [(t or "").encode().lower().split() for t in texts]
    one, two = Counter(w for ws in words for w in ws), Counter(p for ws in words for p in zip(ws, ws[1:]))
    total = sum(one.values())
    for ws in words:
        s = math.log(one[ws[0]] / total) if ws else 0.0
        for a, b in zip(ws, ws[1:]):
            s += math.log(two[a, b] / one[a]) if two[a, b] >= least else math.log(alpha * one[b] / total)
        yield len(ws), s


@pytest.mark.parametrize("options", [{}, {"hot_floor": 9, "bucket_pairs": 10}])
def test_lm_scores(spark, options):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "B", "b", "the", "x1", "é", "zz", "q"], k=rng.randrange(1, 60))) for _ in range(120)]
    texts += [None, "", " \n", "lone", "of the " * 400, "never seen words here"]
    df = spark.createDataFrame([(i, t, 1, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, base double").repartition(3)
    got = {r.doc_id: r for r in lm_score.scores(df, **options).collect()}
    for i, (n, s) in enumerate(backoff(texts)):
        assert got[i].n_words == n and abs(got[i].log_score - s) < 1e-3 * max(1, n)
        assert (got[i].per_word is None) == (n == 0)
    assert lm_score.scores(df.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"hot_floor": 9, "bucket_pairs": 10}])
def test_lm_counts_are_of_single_words(spark, options):
    """A rare word keeps its own count next to a frequent one whose hash starts with the same 22 bits."""
    first = {}
    one, other = next((first[h], w) for w in map("w{}".format, range(100_000)) if first.setdefault(h := xxh3_64_intdigest(w.encode()) >> 42, w) != w)
    texts = [f"{one} x{k % 5} {one}" for k in range(300)] + [f"{other} y z", f"y {other} z", f"z y {other}", other]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.log_score for r in lm_score.scores(df, **options).collect()}
    assert all(abs(got[i] - s) < 1e-9 * max(1, n) for i, (n, s) in enumerate(backoff(texts)))


def test_lm_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op8_lm_score"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r, (n, s) in zip(rows, backoff([r.text for r in rows])):
        assert got[r.doc_id].n_words == n and abs(got[r.doc_id].log_score - s) < 1e-9 * max(1, n)


def test_lm_scores_without_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (-5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.scores(df).collect()}
    assert set(got) == {None, 1, -5} and got[None].n_words == 4 and abs(got[None].log_score - 2 * got[1].log_score) < 1e-5


SAID = ["", "hi", "\\", "\\e", "\\h###t", "####", "</turn>", "</tur</turn>\n", "### assistant: x", "a\nb", "é  \U0001f600", "\\\\t", "<", "#", "x" * 30_000]


def chat_rows():
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        roles = rng.choice([["system", "user", "assistant"], ["user", "assistant", "user", "assistant"], ["assistant"], ["user", "user"], ["tool: x", None], ["system", "assistant"]])
        rows += [(conv, turn, role, rng.choice([*SAID, None]), "x") for turn, role in enumerate(roles)]
    rows += [(100, 0, "user", "twice", "x")] * 2 + [(101, None, "user", "no turn", "x"), (101, 3, "assistant", "ok", "x"), (None, 0, "assistant", "lone", "x"), (None, 0, "assistant", "lone", "x")]
    rng.shuffle(rows)
    return rows


def test_chat_round_trip(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    made = chat.formatted(df)
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    want = {}
    for conv, turn, role, text, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    back = chat.read_back(made).collect()
    assert sorted(tuple(t.role + t.text for t in r.turns) for r in back if r.conv_id is None) == [("assistantlone",)] * 2
    got = {r.conv_id: r for r in back if r.conv_id is not None}
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()} == want
    assert all(got[c].loss_text == "".join(t for role, t in turns if role == "assistant") for c, turns in want.items())
    for r in made.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        raw = r.formatted.encode()
        assert "".join(s.text for s in r.segments if s.loss) == b"".join(raw[x.start : x.start + x.length] for x in r.spans).decode()
        roles = [role for role, _ in want[r.conv_id]] if r.conv_id is not None else ["assistant"]
        assert r.valid == bool(re.fullmatch("(system )?(user assistant )+", " ".join([*roles, ""])))
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


@pytest.mark.parametrize("roles, at", [(["user", "assistant"], None), (["user", "user"], 1), (["assistant"], 0), (["system", "assistant", "user"], 1)])
def test_first_break(spark, roles, at):
    df = spark.createDataFrame([(1, k, r, "t") for k, r in enumerate(roles)], "conv_id long, turn int, role string, text string")
    assert chat.formatted(df).first().breaks_at == at
