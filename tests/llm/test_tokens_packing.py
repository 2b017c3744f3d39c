"""Prefix counts against the library's own encoding of every prefix; packing
as an exact round trip."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablesight.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, start string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def spec():
    return tokens.read_tokenizer(PATH)


def samples(n=250):
    rnd = random.Random(1)
    parts = [*"abé ñ\n\t  '\"s.lrevd!?123ß 　日本🙂\r", "<|endoftext|>", "the", " of", "'ll", "'re", "\n\n", "   ", "²", "½"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return out + ["", " ", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a  <|endoftext|>", "don't we'll they're\n's  's 'l", "hello world " * 30]


def test_every_prefix(library, spec):
    texts = samples()
    for text, deltas in zip(texts, tokens.PrefixCounter(spec).deltas(texts), strict=True):
        counts = np.concatenate([[0], np.cumsum(np.frombuffer(deltas, np.int8), dtype=int)])
        assert len(counts) == len(text.encode()) + 1
        for i in range(len(text) + 1):
            assert counts[len(text[:i].encode())] == len(library.encode(text[:i], add_special_tokens=False).ids), text[:i]
            if i:  # inside a character, all of it counts
                assert len(set(counts[len(text[:i - 1].encode()) + 1:len(text[:i].encode()) + 1])) == 1


def test_ids_equal_the_library(library, spec):
    encoding, _, _ = tokens.load_encoding(spec)
    for text in samples():
        assert encoding.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


def test_cleared_caches_change_nothing(library, spec, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_UNITS", 20)
    monkeypatch.setattr(tokens, "MAX_PAIRS", 20)
    texts = samples(60)
    got = [int(np.frombuffer(d, np.int8).sum(dtype=int)) for d in tokens.PrefixCounter(spec).deltas(texts, block=50)]
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counted_table(spark, library, spec):
    texts = [*samples(40), None, "x" * 50_000, "word " * 20_000]
    rows = [(i if i else None, t, "c", "c") for i, t in enumerate(texts)] + [(1, texts[1], "c", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = tokens.count_prefixes(df, spec).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        assert by_id[i].n_bytes == len((t or "").encode())
        assert by_id[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids)
    counted = tokens.count_prefixes(df, spec)
    text_of = {x[0]: x[1] or "" for x in rows}
    for r in tokens.tokens_in_prefix(counted, 3).collect():
        t = text_of[r.doc_id].encode()
        end = 3
        while t[end:end + 1] and t[end] & 0xC0 == 0x80:
            end += 1
        assert r.prefix_tokens == len(library.encode(t[:end].decode(), add_special_tokens=False).ids)
    for r in tokens.bytes_within_budget(counted.filter("n_bytes < 1000"), 5).collect():
        fits = [len(text_of[r.doc_id][:i].encode()) for i in range(len(text_of[r.doc_id]) + 1)
                if len(library.encode(text_of[r.doc_id][:i], add_special_tokens=False).ids) <= 5]
        assert r.budget_bytes == max(fits)
    assert all(r.budget_bytes == 0 for r in tokens.bytes_within_budget(counted, 0).collect())
    assert tokens.count_prefixes(df.limit(0), spec).collect() == []


def test_stored_counts(spark, library, spec, tmpdir_path):
    """Answers come from the files: the same after they are read again, for
    budgets of each row's own."""
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(samples(60))], SCHEMA)
    stored = tokens.store_prefixes(df, spec, f"{tmpdir_path}/counts")
    assert stored.inputFiles()
    budget = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in tokens.bytes_within_budget(tokens.tokens_in_prefix(stored, F.col("n_bytes")), budget).collect():
        t, most = texts[r.doc_id], r.doc_id % 7 if r.doc_id % 3 else 0
        assert r.prefix_tokens == r.n_tokens == len(library.encode(t, add_special_tokens=False).ids)
        assert r.budget_bytes == max(len(t[:i].encode()) for i in range(len(t) + 1) if len(library.encode(t[:i], add_special_tokens=False).ids) <= most)


def test_token_query(spark, library):
    from tablesight.llm.queries import op10_token_counts
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op10_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
        cut = t.encode()[:r.budget_bytes].decode()
        assert len(library.encode(cut, add_special_tokens=False).ids) <= 1024 and (n > 1024 or cut == t)


def test_not_utf8(spark, library, spec):
    """Bytes that aren't UTF-8 are replaced as by Spark's make_valid_utf8."""
    df = spark.sql("select * from values (1L, cast(X'61FF62' as string)), (2L, cast(X'C3' as string)), (3L, 'é') as t(doc_id, text)")
    want = {1: "a\ufffdb", 2: "\ufffd", 3: "é"}
    for r in tokens.count_prefixes(df, spec).collect():
        assert (r.n_bytes, r.n_tokens) == (len(want[r.doc_id].encode()), len(library.encode(want[r.doc_id], add_special_tokens=False).ids))
    check_packing(list(want.items()), packing.pack_documents(df, spec).collect(), library)


def check_packing(rows, pieces, library):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for d, t in rows}
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == ps[0].sequence_tokens <= 2048 and at & (at - 1) == 0


def test_packing_round_trip(spark, library, spec):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["alpha", "of", "the", "xyzzy", "é"]) for _ in range(rnd.choice([0, 1, 5, 60, 300, 900, 5000])))) for i in range(120)]
    rows += [(500, None), (501, "")]
    df = spark.createDataFrame([(d, t, "c", "c") for d, t in rows], SCHEMA)
    for parts in (1, 5):
        check_packing(rows, packing.pack_documents(df.repartition(parts), spec).collect(), library)
    assert packing.pack_documents(df.limit(0), spec).collect() == []
    again = packing.pack_documents(spark.createDataFrame([(1, "a b", "", ""), (1, "a b", "", ""), (None, "c", "", "")], SCHEMA), spec).collect()
    assert sum(p.length for p in again) == 3 + 3 + 2


def test_windows_are_full():
    rnd = random.Random(3)
    for _ in range(50):
        lengths = [rnd.choice([1, 3, 255, 256, 300, 2047, 2048, 2049, 9000, rnd.randint(1, 5000)]) for _ in range(rnd.randint(0, 40))]
        windows, rest = packing.pack(lengths)
        assert all(sum(n for *_, n in w) in packing.TIERS for w in windows)
        assert sum(n for *_, n in rest) < 2048
        tail = packing.tail_windows(rest)
        seen = sorted(p for w in windows + tail for p in w)
        assert sum(n for *_, n in seen) == sum(lengths)
        for (d, at, n), (e, to, _) in zip(seen, seen[1:]):
            assert (d == e and at + n == to) or (d < e and to == 0)


def test_step_groups_are_even(spark, spec):
    df = spark.createDataFrame([(i, "some words of text " * 200, "", "") for i in range(300)], SCHEMA).coalesce(1)
    groups = defaultdict(dict)
    for p in packing.pack_documents(df, spec, step_tokens=8192).collect():
        groups[p.step_group][p.sequence_id] = p.sequence_tokens
    totals = sorted(sum(g.values()) for g in groups.values())
    assert all(len(set(g.values())) == 1 for g in groups.values()) and totals[-1] == 8192
    assert sum(t == 8192 for t in totals) >= len(totals) - 12


def test_refuses_odd_tiers(spark, spec):
    with pytest.raises(ValueError):
        packing.pack_documents(spark.createDataFrame([], SCHEMA), spec, tiers=(300, 2048))
