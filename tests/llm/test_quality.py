"""Quality counts against plain Python, thresholds against sorted ranks."""

import random
import re

from tablesight.llm.quality import FENCE, SKETCH_ERROR, quality, quantiles, sketch, text_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered)]


def samples():
    rnd = random.Random(2)
    out = ["", " \n", "a", "a b c d e a b c d e", "x\nx\n\n x\nx", "été # $ über\u00a0x", "a b c d e f " * 4, "\x1f\x85 z", "日本 語\r\n日本 語"]
    out += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))) for _ in range(40)]
    return out


def test_counts():
    texts = samples()
    assert text_counts([t.encode() for t in texts]).tolist() == [counts(t) for t in texts]


def test_sketch_quantiles_merge(spark):
    rnd = random.Random(1)
    values = [rnd.lognormvariate(0, 2) for _ in range(3000)] + [0.0] * 100
    df = spark.createDataFrame([("a" if i % 2 else "b", v) for i, v in enumerate(values)], "g string, value double")
    row = quantiles(sketch(df, ["g"]), [], [0.1, 0.5, 0.99]).first()
    ordered = sorted(values)
    for q, got in zip((0.1, 0.5, 0.99), (row.q0, row.q1, row.q2)):
        want = ordered[max(0, -int(-q * len(ordered) // 1) - 1)]
        assert abs(got - want) <= 1.01 * SKETCH_ERROR * want
    assert row.total == len(values)


def test_verdicts(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rnd.randint(0, 99)) for _ in range(50)), "en", "s", "x") for i in range(300)]
    rows += [(900, "### $$$ " * 3 + " ".join(f"word{i} ###" for i in range(30)), "en", "s", "x"), (901, " ".join("y" * 60 + str(i) for i in range(20)), "en", "s", "x"),
             (902, None, None, None, "x"), (903, "too short", "en", None, "x"), (904, rows[0][1], None, "s", "x"), (904, rows[0][1], None, "s", "x")]
    got = {(r.doc_id): r for r in quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(300)) and got[904].kept
    assert not got[900].kept and not got[900].base_failed and "symbols_per_word" in got[900].failed
    assert not got[901].kept and "mean_word_chars" in got[901].failed
    assert got[902].base_failed and got[903].base_failed and not got[902].kept
    assert got[902].n_words == 0 and FENCE > 0


def test_each_measure_rejects_outliers_that_pass_the_base_rules(spark):
    rnd = random.Random(7)
    plain = lambda n, k: [f"{rnd.choice(['alpha', 'beta', 'gamma', 'delta'])}{k}{rnd.randint(10, 99)}" for _ in range(n)]
    rows = [(i, " ".join(plain(60, i % 10)), "en", "s", "x") for i in range(400)]
    phrase = plain(9, 3)
    lines = [" ".join(plain(3, 1)) for _ in range(15)]
    odd = {"symbols_per_word": " ".join(plain(56, 2) + ["a#b"] * 4), "repeat_word_share": " ".join(plain(40, 4) + phrase + plain(42, 5) + phrase),
           "dup_line_share": "\n".join(x for i, a in enumerate(lines) for x in ([a, "gamma100"] if i < 6 else [a])), "mean_word_chars": " ".join(w + "x" for w in plain(60, 6))}
    rows += [(1000 + i, t, "en", "s", "x") for i, t in enumerate(odd.values())]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(not got[i].kept for i in range(400)) <= 4
    for i, measure in enumerate(odd):
        assert not got[1000 + i].base_failed and got[1000 + i].failed == [measure]


def test_empty_table(spark):
    assert quality(spark.createDataFrame([], SCHEMA)).collect() == []
