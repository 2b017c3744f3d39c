"""URL filters, source mixing and shard placement against plain Python."""

import functools
import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tablesight.llm import mixing, sharding, urlfilter

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        raw, slash, tail = rest.partition("/")
        host, path = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in raw), slash + tail
    best = None
    for verdict, rule in RULES:
        h, s, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    if best:
        return host, path, best[1], best[0]
    bad = re.search(r"(^|[.-])(casino|bets|cheap-pills|porn|xxx|viagra|payday-loans)([.-]|$)", host)
    return host, path, None, "block" if bad else "allow"


def test_urls(spark):
    urls = ["http://example.org/es/x", "https://EXAMPLE.org/en/123", "http://www.example.org/en/2", "http://org", "http://org/", "http://notexample.org/es/",
            "ftp://a.com/fr/?q=/de/", "http://a.com/de#x", "http://a.com/de/x", "http://a.net/de/", "http://free-bets.example.net/", "http://alphabets.net/",
            "http://x.casino/", "http://casino.x/com/de/", "http://a?b/c", "no url", "", None, "://", "http://É.org/ES/", "http://e.org/é\n/x", "a://b://org/",
            "http://example.org/ES/", "http://xorg/", "http://cheap-pills.com/fr/", "http://cheap.pills.net/"] + ["http://hot.example.com/p"] * 50
    rows = [(i if i != 3 else None, u, "h", "clash") for i, u in enumerate(urls)] + [(0, urls[0], "h", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted([tuple(r) for r in urlfilter.judge(df).collect()], key=str)
    assert got == sorted([(i, *judge(u)) for i, u, *_ in rows], key=str)
    plan = urlfilter.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert urlfilter.judge(df.limit(0)).collect() == []


def test_rule_needs_a_token(spark):
    with pytest.raises(ValueError):
        urlfilter.rule_table(spark, [("allow", "/x")], [])


@pytest.mark.parametrize("most", [urlfilter.MAX_BROADCAST_RULES, 100])
def test_rules_from_a_table(spark, monkeypatch, most):
    """10,000 site rules and 300 patterns, broadcast or shuffled, against a plain search."""
    monkeypatch.setattr(urlfilter.few, "__defaults__", (most,))
    sites = spark.range(10_000).selectExpr("if(id % 3 = 0, 'block', 'allow') as verdict",
                                           "concat('H', id % 700, '.net/p', id % 9, '/', if(id % 2 = 0, '', concat('x', id % 50))) as rule").distinct()
    sites = sites.union(spark.createDataFrame([("block", r"h1.net/a\\E.b/"), ("allow", None)], sites.schema))
    patterns = spark.range(300).selectExpr("concat('^([^/]*[.-])?bad', id, '([.-][^/]*)?(/|$)') as pattern", "array(concat('bad', id)) as tokens")
    rnd = random.Random(4)
    urls = [f"http://{rnd.choice(['', 'www.', 'bad7-', 'BAD299.'])}h{rnd.randint(0, 720)}.net/p{rnd.randint(0, 9)}/{rnd.choice(['', 'x1', 'x31/y', 'X3'])}" for _ in range(600)]
    urls += [r"http://h1.net/a\\E.b/c", "http://h1.net/aE.b/c", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [(r.verdict, r.rule) for r in sites.collect() if r.rule]
    for r in urlfilter.judge(df, sites, patterns).collect():
        fits = [(-len(u), u, v) for v, u in rules for h, s, p in [u.partition("/")]
                if (r.host == h.lower() or r.host.endswith("." + h.lower())) and r.path.startswith(s + p)]
        bad = re.search(r"(^|[.-])bad([12]?[0-9]?[0-9])([.-]|$)", r.host)
        assert (r.rule, r.verdict) == ((min(fits)[1:]) if fits else (None, "block" if bad else "allow")), r
    with pytest.raises(Exception, match="literal token"):
        urlfilter.judge(df, sites.limit(0), patterns.withColumn("tokens", F.expr("filter(tokens, t -> false)"))).collect()
    assert {r.verdict for r in urlfilter.judge(df, [], []).collect()} == {"allow"}


def targets(sizes):
    """Shares in exact fractions: cap and share again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: Fraction(2 * sizes[s]) for s in over})


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {s: rnd.choice([0, 1, 7, 100, 5000]) for s in ["b", "a", "ä", "Z", "", None][:rnd.randint(1, 6)]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert {s: pytest.approx(float(t)) for s, t in targets(sizes).items()} == got


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("w" * rnd.randint(1, 60)) if i % 7 else None, rnd.choice(["hot", "hot", "x", "y", None]), 5, "s") for i in range(4000)]
    rows += [rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string")
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    want, taken = targets(dict(sizes)), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert r.size == len((r.text or "").split()) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.06 * want[s]
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and Counter(map(tuple, out.collect())) == Counter(
        {x: n for x, n in Counter(t for r in got for t in [next(q for q in rows if q[0] == r.doc_id)] * r.copies).items()})
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mixed_documents(df.limit(0)).collect() == []


def test_mix_of_null_ids(spark):
    """Rows of null ids draw by their texts: their source comes near its target."""
    rows = [(None if i % 5 else i, f"w{i} " + "w " * (i % 9), "abc"[i % 3]) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "bc":  # the extra copies of a are certain
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.06 * mine[0].target
        assert len({r.copies for r in mine if r.doc_id is None}) == 2


def test_sharding(spark):
    shards = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(shards)
    load = Counter(table.tolist())
    assert max(load.values()) - min(load.values()) <= 1 and len(load) == 20
    # Plain version of taking turns.
    place, step, own, free = [], [], [[] for _ in range(3)], set(range(307))
    for name in ("a", "b", "c"):
        d = hashlib.sha256(name.encode()).digest()
        place.append(int.from_bytes(d[:8], "big") % 307)
        step.append(int.from_bytes(d[8:16], "big") % 306 + 1)
    turn = 0
    while free:
        k = turn % 3
        slot = next(s for s in ((place[k] + j * step[k]) % 307 for j in range(307)) if s in free)
        free.remove(slot)
        own[k].append(slot)
        turn += 1
    small = sharding.lookup_table(["a", "b", "c"], 307)
    assert [sorted(own[k]) for k in range(3)] == [[i for i in range(307) if small[i] == k] for k in range(3)]
    # Order doesn't matter; removing a shard moves few of the others' slots.
    assert [shards[i] for i in table] == [shards[::-1][i] for i in sharding.lookup_table(shards[::-1])]
    less = sharding.lookup_table(shards[:-1])
    moved = sum(1 for a, b in zip(table, less) if a != 19 and a != b)
    assert moved < 0.25 * len(table)
    rows = [(i, "t", "old") for i in range(500)] + [(None, None, "old"), (3, "t", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.place(df, shards).collect()
    assert len(got) == len(rows) and sharding.place(df.limit(0), shards).collect() == []
    for r in got:
        slot = int(hashlib.md5((f"key:{r.doc_id}" if r.doc_id is not None else "null:").encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert r.slot == slot and r.shard == shards[table[slot]]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


@functools.cache
def lookup(shards):
    return sharding.lookup_table(list(shards))


def shard_of(key, shards):
    slot = int(hashlib.md5((f"key:{key}" if key is not None else "null:").encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
    return slot, shards[lookup(tuple(shards))[slot]]


def test_write_shards(spark, tmpdir_path):
    shards = ["7", "08", "c"]  # digits stay text
    rows = [(i, "text %d" % i, "mine") for i in range(300)] + [(None, None, "x"), (5, "", "x")] + [(9, "hot", "x")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, Slot string").repartition(6)
    back = sharding.write_shards(df, f"{tmpdir_path}/out", shards, slot_col="place")
    assert back.columns == ["doc_id", "text", "Slot", "place", "shard"]
    assert Counter(map(tuple, back.collect())) == Counter((*r, *shard_of(r[0], shards)) for r in rows)
    replaced = sharding.place(df, shards)
    assert replaced.columns == ["doc_id", "text", "slot", "shard"]
    assert Counter(map(tuple, replaced.collect())) == Counter((*r[:2], *shard_of(r[0], shards)) for r in rows)
    assert sharding.write_shards(df.limit(0), f"{tmpdir_path}/none", shards).collect() == []


def test_hot_shard_is_split(spark, tmpdir_path):
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(4000, numPartitions=8).selectExpr("7L as doc_id", "sha2(string(id), 512) as text")
        back = sharding.write_shards(df, f"{tmpdir_path}/hot", ["a", "b"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert back.count() == 4000 and len(back.inputFiles()) > 3


def test_sharding_query(spark):
    from tablesight.llm.queries import SHARDS, op5_sharding
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = op5_sharding(spark, "/root/testdata/sf0.001").collect()
    assert Counter(map(tuple, got)) == Counter((d.doc_id, *shard_of(d.doc_id, SHARDS), len((d.text or "").encode())) for d in docs)
