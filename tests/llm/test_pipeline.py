"""Every stage of the pipeline against a brute-force version on its own input."""

import hashlib
from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline as cp
from helioframe.llm import near_dedup, toxicity
from helioframe.session import cut_lineage
from tests.llm.test_pairs import grams, reach
from tests.llm.test_text_operators import hit_words, same_tokens

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_nothing_is_toxic_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (None, "other words")], "doc_id long, text string")
    for labels in ([], [(77777, 1)]):
        folder = str(tmp_path / str(len(labels)))
        spark.createDataFrame(labels, "doc_id long, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
        assert cp.not_toxic(spark, docs, folder).count() == 3


def test_stages(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES:
        after = cut_lineage(stage(spark, before, SF), name)
        rows, got = before.collect(), after.collect()
        if name != "token_ids":
            assert after.columns == COLUMNS
        if name == "toxicity":
            weights = {r.bucket: r.weight for r in toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            score = lambda t: sum(weights.get(b, 0) for b in toxicity.features((t or "").encode())) + weights.get(1 << toxicity.BITS, 0)
            want = [r for r in rows if score(r.text) < 0]
        elif name == "near_dedup":
            sets = {r.doc_id: grams(r.text) for r in rows}
            ids = sorted(sets)
            links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            want = [r for r in rows if reach(ids, links)[r.doc_id] == r.doc_id]
            assert len(want) < len(rows)
        elif name == "decontamination":
            hits = {r.doc_id: hit_words(r.text, bench, 13) for r in rows}
            want = [r for r in rows if not (hits[r.doc_id][1] and 20 * hits[r.doc_id][1] >= hits[r.doc_id][0])]
        elif name == "mixing":
            size = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
            words = Counter()
            for r in rows:
                words[r.source] += size[r.doc_id]
            weight = dict(zip(sorted(words), [3, 1, 2] * len(words)))
            target, open_ = {}, set(words)
            while True:
                level = (1.5 * sum(words.values()) - sum(target.values())) / sum(weight[s] for s in open_)
                above = {s for s in open_ if level * weight[s] > 2 * words[s]}
                if not above:
                    break
                target |= {s: 2 * words[s] for s in above}
                open_ -= above
            target |= {s: level * weight[s] for s in open_}
            want = []
            for r in rows:
                rate = target[r.source] / words[r.source] if words[r.source] else 0.0
                coin = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
                want += [r] * (int(rate) + (coin < rate - int(rate)))
        else:
            same_tokens(sorted(got, key=lambda r: r.start), rows)
            continue
        assert Counter(got) == Counter(want)
        before = after


def test_registered(spark):
    out = entry.queries()["pipeline"](spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (1, "A b c d e f", 2), (2, "a b c d e f", 3), (3, None, 4), (3, None, 4), (None, "a b c d e f", 5), (4, "", 6), (5, "other words", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hash int")
    out = near_dedup.dedup(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 3, 3, None, 4, 5])
    assert near_dedup.dedup(df.limit(0)).count() == 0
