"""Repeat removal against a count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tablesight.llm import suffix

SCHEMA = "doc_id long, text string, kept string, n_bytes string"


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = suffix.remove_repeats(df, **more).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got], key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [text(rnd.choice([20, 35, 40, 60, 200])) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rnd.randint(0, 60)) for _ in range(3)]
        for _ in range(rnd.choice([0, 1, 2])):
            p = rnd.choice(passages)
            a = rnd.randint(0, 60)
            p = p[a:] if rnd.random() < 0.5 else p
            if rnd.random() < 0.4:
                k = rnd.randrange(len(p))
                p = p[:k] + "#" + p[k + 1:]
            parts.insert(rnd.randrange(len(parts)), p)
        rows.append((i, rnd.choice(["", " "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_hot_gram_is_split(spark, monkeypatch):
    """A passage in many surroundings, with the limit low: same result."""
    monkeypatch.setattr(suffix, "MAX_SEGMENTS", 3)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rnd = random.Random(6)
    long = "".join(rnd.choice("xyz ") for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 199), (5, "b" * 200), (6, "c" * 201), (7, "d" * 5000), (8, "ab" * 300),
            (9, long), (10, long[12_345:12_600]), (11, "é" * 100), (12, "€" + "é" * 100), (13, "same row " * 40), (13, "same row " * 40),
            (None, "null id " * 40), (14, long[:150] + long[:150])]
    assert run(spark, rows) == brute(rows)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 1000)
    rnd = random.Random(7)
    long = "".join(rnd.choice("pqrs ") for _ in range(7_000))
    rows = [(1, long), (2, "x" + long[900:1300]), (3, long[1990:2195]), (4, long[4000:4199])]
    assert run(spark, rows) == brute(rows)


def test_transform_against_counts():
    rnd = random.Random(3)
    for _ in range(40):
        base = bytes(rnd.choice(b"ab") for _ in range(300))
        strings = []
        for _ in range(rnd.randint(1, 6)):
            a = rnd.randint(0, 250)
            x = bytearray(base[a:a + rnd.randint(5, 120)])
            if rnd.random() < 0.6:
                x[rnd.randrange(len(x))] = rnd.choice(b"abc")
            strings.append(bytes(x))
        count = Counter(s[i:i + 20] for s in strings for i in range(len(s) - 19))
        want = [f for s in strings for f in [i + 20 <= len(s) and count[s[i:i + 20]] > 1 for i in range(len(s))] + [False]]
        assert suffix.repeated_starts(strings, 20).tolist() == want


def test_carried_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "t", "x", "y")], SCHEMA)
    out = suffix.remove_repeats(df.withColumnRenamed("n_bytes", "more"), carry=["more"])
    assert out.columns == [*suffix.OUTPUT, "more"] and out.first().more == "y"
    with pytest.raises(ValueError):
        suffix.remove_repeats(df, carry=["kept"])
    with pytest.raises(ValueError):
        suffix.remove_repeats(df, length=50)
    assert suffix.remove_repeats(df.limit(0)).collect() == []
