"""MinHash near-dedup against brute force on full shingle sets."""

import random

from pyspark.sql import types as T

from tablesight.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, n_shingles string, kept string"


def brute(rows, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(members) if doc is not None else None
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return sorted([tuple(r) for r in near_duplicates(df).collect()], key=str)


def texts(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([8, 60, 150, 300]))]
        for _ in range(rnd.choice([1, 2, 6, 14])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((len(rows), rnd.choice([" ", "\n", "\t "]).join(words)))
    return rows


def test_matches_brute_force(spark):
    rows = texts()
    assert run(spark, rows) == brute(rows)


def test_chain_of_copies(spark):
    """Each text is near the next only; the chain is one component."""
    words = [f"v{i}" for i in range(260)]
    rows = [(100 - k, " ".join(words[3 * k:3 * k + 120])) for k in range(20)]
    got = run(spark, rows)
    assert got == brute(rows) and len({r[2] for r in got}) == 1


def test_matches_brute_force_at_80(spark):
    """Texts of 100 words, of which 2 are changed, share 86 of 106 shingles."""
    rnd = random.Random(8)
    rows = texts(9)
    for g in range(10):
        base = [f"g{g}w{i}" for i in range(100)]
        for k in range(3):
            words = list(base)
            for place in rnd.sample(range(5, 95, 6), k):
                words[place] = f"new{g}{k}{place}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = sorted([tuple(r) for r in near_duplicates(df, percent=80).collect()], key=str)
    assert got == brute(rows, 80) != brute(rows, 85)


def test_edge_cases(spark):
    long = " ".join(f"x{i % 5000}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (5, "ONE  two"), (6, "one two three"),
            (7, long), (8, long + " end"), (None, "one two"), (9, "É b c d e"), (10, "é b c d e")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], T.StructType.fromDDL(SCHEMA))
    assert near_duplicates(df).collect() == []


def test_ids_with_several_texts(spark):
    """The texts of an id share its links; rows stay as many as they were."""
    from tablesight.llm.minhash import near_duplicates
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    rows = [(1, texts["a"]), (1, texts["b"]), (2, texts["a"] + " x"), (3, texts["b"] + " x"), (9, texts["c"]), (8, texts["c"] + " x"), (9, None), (4, "alone of its kind here now")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (8, 8), (9, 8), (9, 9)]


def test_filter_keeps_all_candidates(spark):
    from tablesight.llm.minhash import possible
    docs = spark.range(5000).selectExpr("id * 7919 - 9000 as doc_id", "'t' as text")
    ids = docs.filter("doc_id % 10 = 0").selectExpr("doc_id as doc")
    got = {r.doc_id for r in possible(docs, ids, "doc_id").collect()}
    want = {r.doc for r in ids.collect()}
    assert want <= got and len(got) < 2 * len(want)
    assert possible(docs, ids.limit(0), "doc_id").count() == 0
