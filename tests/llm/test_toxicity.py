"""Toxicity: held-out accuracy, and the models against plain counting."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablesight.llm import toxicity
from tablesight.llm.shared import Scratch

SCHEMA = "doc_id long, text string, score string"


def corpus(n=700, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(1500)]
    bad = ["vile", "crud", "numpty", "wretch"]
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.25
        text = [rnd.choice(words[:200]) if rnd.random() < 0.6 else rnd.choice(words) for _ in range(rnd.choice([30, 80, 200]))]
        if toxic:
            for _ in range(max(3, len(text) // 25)):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    more = [(10_001, None, "x"), (10_002, "", "x"), (10_003, "... !!", "x"), (None, "vile wretch " * 9, "x"), (5, docs[5][1], "x"),
            (10_004, docs[7][1], "x"), (10_005, "vile vile " * 20_000, "x")]
    odd = [(1, None), (None, 1), (2, 7), (3, labels[3][1])]
    d = spark.createDataFrame(docs + more, SCHEMA)
    out = toxicity.score(d, spark.createDataFrame(labels + odd, "doc_id long, toxic int"))
    return docs, dict(labels), out.collect()


def test_held_out_accuracy(scored):
    docs, label, rows = scored
    assert len(rows) == len(docs) + 7
    right, total = 0, 0
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.held_out and r.doc_id in label:
            total += 1
            right += r.predicted == label[r.doc_id]
    assert total > 100 and right >= 0.95 * total


def test_plain_ratio_beside_the_score(scored, spark, monkeypatch):
    """Both signs, per word: a floor far below all ratios gives the same sum."""
    docs, label, rows = scored
    ratio = {r.doc_id: r.log_ratio for r in rows}
    assert ratio[10_001] == ratio[10_002] == 0 and ratio[10_005] > 0 and min(ratio.values()) < 0
    sides = [[ratio[i] for i in label if i in ratio and label[i] == c] for c in (0, 1)]
    assert np.mean(sides[1]) > np.mean(sides[0])
    labels = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, SCHEMA), labels, Scratch(spark, "test"))
    monkeypatch.setattr(toxicity, "CLEAR", -100.0)
    evidence, plain, n = model.measure([t.encode() for _, t, _ in docs])
    assert (n > 0).all() and np.allclose(evidence - 100, plain, atol=1e-3)


def test_only_the_text_counts(scored):
    docs, _, rows = scored
    by = {r.doc_id: r.score for r in rows}
    assert by[10_004] == by[7] and by[10_001] == by[10_002] == by[10_003] < toxicity.THRESHOLD
    assert by[10_005] >= toxicity.THRESHOLD and by[None] >= toxicity.THRESHOLD


def test_model_against_plain_counts(spark):
    docs, labels = corpus(200, 4)
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    scratch = Scratch(spark, "test")
    model = toxicity.fit(d, lab, scratch)
    train = spark.read.parquet(f"{scratch.root}/1").selectExpr("_id", "text", "toxic", "pmod(xxhash64('check', _id), 5) = 0 as checked").collect()
    assert {r._id for r in train} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    pairs, shared = defaultdict(Counter), Counter(w for _, t, _ in docs for w in t.split())
    for r in train:
        if not r.checked:
            words = r.text.split()
            pairs[r.toxic].update(zip([None, *words], words))
    total = sum(shared.values()) + toxicity.WORD_SLOTS
    text = docs[0][1]
    want = []
    for w in text.split():
        ratio = []
        for c in (0, 1):
            types = Counter(b for _, b in pairs[c])
            n = sum(types.values())
            rest = 1 - sum(max(k - toxicity.DISCOUNT, 0) for k in types.values()) / n
            ratio.append(max(types[w] - toxicity.DISCOUNT, 0) / n + rest * (shared[w] + 1) / total)
        want.append(ratio)
    for _, slots, _, _ in toxicity.word_pairs([text.encode()]):
        got = np.array([[model.word[c][s] for c in (0, 1)] for s in slots])
    # Slots are shared by chance now and then, so compare the bulk.
    assert np.quantile(np.abs(got / np.array(want) - 1), 0.9) < 1e-3

    both, words, d = Counter([*pairs[0], *pairs[1]]), text.split(), toxicity.DISCOUNT
    after = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for i, counts in enumerate((pairs[0], pairs[1], both)):
        for (h, _), n in counts.items():
            after[0][i][h] += n
            after[1][i][h] += 1
    def level(i, counts, h, w, below):
        n = after[0][i][h]
        return max(counts[h, w] - d, 0) / n + d * after[1][i][h] / n * below if n else below
    plain = [[level(c, pairs[c], h, w, level(2, both, h, w, below)) for c, below in enumerate(lower)]
             for h, w, lower in zip([None, *words], words, want, strict=False)]
    (_, slots, before, keys), = toxicity.word_pairs([text.encode()])
    at, pair = toxicity.find(model.words, before), toxicity.find(model.pairs, keys)
    got = np.stack([model.direct[c][pair] + model.rest[c][at] * model.word[c][slots] for c in (0, 1)], 1)
    assert np.quantile(np.abs(got / np.array(plain) - 1), 0.9) < 1e-3


def test_repeating_a_text_leaves_its_verdict(spark):
    docs, labels = corpus()
    model = toxicity.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), Scratch(spark, "test"))
    texts = [t.encode() for (_, t, _), (_, toxic) in zip(docs, labels, strict=True) if not toxic]
    once, _ = model.evidence(texts)
    score = model.score(texts)
    chance = [i for i in np.argsort(-once) if score[i] < toxicity.THRESHOLD / 2 and once[i] > 0][:10]
    assert chance
    often = [b" ".join([texts[i]] * 1000) for i in chance]
    assert (model.score(often) < toxicity.THRESHOLD).all()


def test_counts_are_exact_and_whole(spark, monkeypatch):
    """No two words share a count, and bigrams seen once are kept."""
    monkeypatch.setattr(toxicity, "HELD_WORDS", 500)
    docs = [(i, " ".join(f"w{i * 1500 + k}" for k in range(1500)) + " twice twice", "x") for i in range(60)]
    d = spark.createDataFrame(docs, SCHEMA)
    counts = Counter(w for _, t, _ in docs for w in t.split())
    got = toxicity.corpus_counts(d).toPandas()
    assert len(got) == len(counts) and Counter(got["n"]) == Counter(counts.values())
    scratch = Scratch(spark, "test")
    model = toxicity.fit(d, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"), scratch)
    train = spark.read.parquet(f"{scratch.root}/1").selectExpr("text", "pmod(xxhash64('check', _id), 5) = 0 as checked").collect()
    pairs = {p for r in train if not r.checked for p in zip([None, *r.text.split()], r.text.split())}
    assert len(model.pairs) == len(pairs) and (np.diff(model.pairs) > 0).all()
    assert len(model.words) == len({w for p in pairs for w in p})
    for c in (0, 1):
        assert len(model.direct[c]) == len(pairs) + 1 and ((model.rest[c] > 0) & (model.rest[c] <= 1)).all()


def test_no_labels_and_empty_table(spark):
    docs, _ = corpus(20)
    d = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(d, none).collect())
    assert toxicity.score(d.limit(0), none).collect() == []
