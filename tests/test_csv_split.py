"""CSV with quoted newlines in blocks: equal to Python's csv module, whatever
the borders."""

import csv
import os
import random

import pytest

from tablesight.sources import readers as S
from tablesight.sources.csv_split import csv_records


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


@pytest.fixture()
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(seed, n=300):
    rnd = random.Random(seed)
    pieces = ["a", "bé", '"', ",", "\n", "\n\n", "x y", ";", "日本", '""', " ", "\r\n"]
    out = [["id", "text", "more, than one\nline"]]
    for i in range(n):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12)))
        if i % 37 == 0:
            text = "z\n" * 900 + '"'  # longer than a block
        out.append([str(i), "t" + text, rnd.choice(["", "v", '"q"', "two\nlines"])])
    return out


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n")])
def test_equals_csv_module(spark, small_blocks, tmpdir_path, seed, end):
    folder = f"{tmpdir_path}/c"
    os.makedirs(folder)
    parts = [rows(seed), rows(seed + 10, 40), [rows(seed)[0]]]
    for i, part in enumerate(parts):
        write(f"{folder}/p{i}.csv", part, end)
    df = S.read_csv(spark, folder, multiline="split", infer=False, na_tokens=["never"])
    assert spark.read.text(folder).rdd.getNumPartitions() > 10
    assert df.columns == rows(seed)[0]
    got = sorted(tuple(x or "" for x in r) for r in df.collect())
    assert got == sorted(tuple(r) for part in parts for r in part[1:])


def test_equals_multiline_reader(spark, small_blocks, tmpdir_path):
    write(f"{tmpdir_path}/a.csv", [r[:2] for r in rows(5)])
    split, whole = (S.read_csv(spark, f"{tmpdir_path}/a.csv", multiline=m) for m in ("split", True))
    assert split.dtypes == whole.dtypes and sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))


def test_order_of_records(spark, small_blocks, tmpdir_path):
    write(f"{tmpdir_path}/a.csv", rows(7))
    got = csv_records(spark, f"{tmpdir_path}/a.csv").orderBy("file", "block", "line").collect()
    assert [r.text.split(",")[0] for r in got] == ["id"] + [str(i) for i in range(300)] and [r.begins for r in got].count(True) == 1


def test_shuffled_states(spark, small_blocks, tmpdir_path, monkeypatch):
    from tablesight.sources import csv_split
    monkeypatch.setattr(csv_split, "MAX_BROADCAST", 0)
    write(f"{tmpdir_path}/a.csv", rows(8))
    got = S.read_csv(spark, f"{tmpdir_path}/a.csv", multiline="split", infer=False, na_tokens=["never"]).collect()
    assert sorted(tuple(x or "" for x in r) for r in got) == sorted(map(tuple, rows(8)[1:]))


def test_edges(spark, tmpdir_path):
    def put(name, text):
        os.makedirs(f"{tmpdir_path}/{name}")
        with open(f"{tmpdir_path}/{name}/x.csv", "w", newline="") as f:
            f.write(text)
        return f"{tmpdir_path}/{name}"
    read = lambda p: S.read_csv(spark, p, multiline="split")
    assert [tuple(r) for r in read(put("blank", '\n\na,b\n\n1,"x\n\ny"\n\n2,\n')).collect()] == [(1, "x\n\ny"), (2, None)]
    assert [tuple(r) for r in read(put("short", 'a,b\n1\n"2",3')).collect()] == [(1, None), (2, 3.0)]
    assert read(put("none", "")).collect() == [] and read(put("header", "a,a\n")).columns == ["a", "a.1"]
    with pytest.raises(Exception, match="more fields"):
        read(put("long", "a,b\n1,2,3\n")).collect()
    with pytest.raises(ValueError, match="inside a quoted field"):
        read(put("open", 'a,b\n1,"2\n3,4\n'))
    two = put("two", "a,b\n1,2\n")
    write(f"{two}/y.csv", [["b", "a"], ["1", "2"]])
    with pytest.raises(ValueError, match="different headers"):
        read(two)
