"""Spelling variants against plain edit distance, and odd inputs."""

import random
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
from tablesight.llm import spelling
from tablesight.llm.spelling import search_block, variants, word_counts

SF = "/root/testdata/sf0.001"


def one_error(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, least=5):
    n = {w: k for w, k in counts.items() if k >= least}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    form, near = {}, {}
    for w in n:
        near[w] = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_error(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def runs(docs, alter=199):
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % alter == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                out[run] += 1
    return out


def vocabulary(seed, n=250, letters="abé"):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(6, 11))) for _ in range(n)}
    return {w: rnd.choice([1, 5, 6, 25, 26, 30, 150, 1000]) for w in words}


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.mark.parametrize("seed", range(3))
def test_variants(spark, seed):
    counts = vocabulary(seed)
    assert rows(variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_split_groups(spark, monkeypatch):
    """Groups cut into parts, every two of which are compared."""
    monkeypatch.setattr(spelling, "GROUP_LETTERS", 0)
    counts = {"abcdef" + w: n for w, n in vocabulary(8, 300, "xyz").items()}
    assert rows(variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_block_takes_a_pair_once():
    words = [b"abcdef", b"abcxef", b"abdef", b"abcdefg", b"bcdef", b"abcdefz", b"xbcdef"]
    total = Counter()
    for half in (2, 3):
        for from_end in (False, True):
            at, counts, _ = search_block(words, half, from_end)
            total.update(dict(zip(at.tolist(), counts.tolist())))
    for i, w in enumerate(words):
        assert total[i] == sum(one_error(w, v) for v in words)


def test_chains_ties_and_odd_rows(spark):
    counts = [("aaaaaa", 1000), ("aaaaab", 200), ("aaaabb", 40), ("aaabbb", 8), ("zzzzzz", 5), ("zzzzzy", 25), ("zzzzzx", 25),
              ("longer" * 3000, 5), ("longer" * 3000 + "s", 30), (None, 9), ("nullnull", None), ("twiceee", 2), ("twiceee", 3), ("ab", 5), ("abc", 50)]
    got = {r[0]: r for r in rows(variants(spark.createDataFrame(counts, "word string, n long")))}
    assert got["aaabbb"][1:3] == ("aaaabb", "aaaaaa") and got["zzzzzz"][1] == "zzzzzx"
    assert got["longer" * 3000][1] == "longer" * 3000 + "s" and got["twiceee"][3] == 5 and got["ab"][1] == "abc"
    assert len(got) == 12
    assert variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_word_counts(spark):
    docs = [(i, f"Color colour COLOUR {'x' * (i % 9)} Étéééé caféœcafés pre-fixed re_working {i}abcdefg日abcdefgh") for i in range(400)]
    docs += [(1, None), (2, ""), (None, "Nothing altered hereafter " * 50), (3, docs[3][1]), (3, docs[3][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in word_counts(df, alter_every=199).collect()}
    assert got == runs(docs)
    assert {r.word: r.n for r in word_counts(df).collect()} == runs(docs, 1 << 40)
    broken = spark.sql("select 1L as doc_id, cast(X'616263646566FF616263646566' as string) as text")
    assert [tuple(r) for r in word_counts(broken).collect()] == [("abcdef", 2)]


def test_registered_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(runs(docs))
    assert rows(entry.queries()["op12_spelling_variants"](spark, SF)) == want and any(r[1] for r in want)
