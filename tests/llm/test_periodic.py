"""Periodic runs against all periods tried one by one, and odd inputs."""

import hashlib
import random
import re
import zlib

import pytest

import __spark_entry__ as entry
from tablesight.llm.periodic import find_runs, periodic_runs, word_ids
from tablesight.llm.queries import op13_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, n_words string"


def brute(words):
    """(start, length, period) of all runs: every period over the whole text."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                # The least period wins for a stretch.
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = None
    for s, k, q in runs:
        if best is None or k * best[2] > best[1] * q or (k * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, k, q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def samples(rnd, n=60):
    for _ in range(n):
        words = []
        for _ in range(rnd.randint(1, 5)):
            words += [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60))]
            period = [rnd.choice("ab") for _ in range(rnd.randint(1, 50))]
            words += (period * 12)[:rnd.randint(0, 10 * len(period))]
        yield words


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    for words in samples(random.Random(seed)):
        assert periodic_runs(word_ids([w.encode() for w in words])) == brute(words)


def test_nested_and_repeated_grams():
    rnd = random.Random(3)
    a, b = ([f"{x}{rnd.randint(0, 99)}" for _ in range(40)] for x in "ab")
    for words in ((a + a + b) * 4, (["x"] * 30 + b) * 5, ["x"] * 1000, (a[:8] * 3), a[:8] * 2, (["x"] * 24 + ["y"]) * 3, (a * 3)[:-1], a * 3):
        assert periodic_runs(word_ids([w.encode() for w in words])) == brute(words)


def test_general_interface(spark):
    rows = [(1, "a b " * 20 + "c", "x", "y"), (2, None, "x", None), (2, "", None, "y"), (None, " \n\t", "x", "y"), (1, "a b " * 20 + "c", "x", "y")]
    got = find_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 0, 41, 41]
    for r in got:
        assert [tuple(x) for x in r.runs] == ([(0, 40, 2)] if r.doc_id == 1 else [])
        assert bytes(r.collapsed) == (b"a b c" if r.doc_id == 1 else b"")
    with pytest.raises(ValueError):
        find_runs(spark.createDataFrame(rows, SCHEMA), ["runs"])
    broken = spark.sql("select 1L as doc_id, cast(X'61FF20' as string) as text").unionAll(spark.sql("select 2L, repeat(cast(X'61FF20' as string), 30)"))
    assert {r.doc_id: len(r.runs) for r in find_runs(broken).collect()} == {1: 0, 2: 1}


def test_query_rows(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abc") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(0, 120))), "s", None) for i in range(300)]
    rows += [(1000 + i, " ".join(w), "s", None) for i, w in enumerate(samples(rnd, 20))] + [(7, None, "s", "x"), (7, rows[7][1], None, "x")]
    got = op13_rows(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(digest(d, t)) for d, t, _, _ in rows)
    nothing = op13_rows(spark.createDataFrame([(None, "a " * 30, None, None)], SCHEMA)).first()
    assert nothing.doc_id is None and (nothing.n_runs, nothing.length, nothing.period) == (1, 30, 1)
    assert op13_rows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_registered_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op13_periodic_runs"](spark, SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(digest(d, t)) for d, t in texts.items())
