"""Readers on ragged, reordered and mixed input: nothing is lost silently."""

import os

import pytest

from tablesight.sources import readers as S


def put(folder, **files):
    os.makedirs(folder)
    for name, text in files.items():
        with open(os.path.join(folder, name.replace("_", ".")), "w") as f:
            f.write(text)
    return folder


def test_long_csv_row_raises(spark, tmpdir_path):
    path = put(f"{tmpdir_path}/c", a_csv="a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more fields"):
        S.read_csv(spark, path).collect()


def test_short_csv_row_ends_in_nulls(spark, tmpdir_path):
    path = put(f"{tmpdir_path}/c", a_csv='a,b\n1,2\n3\n"x,y",5\n')
    assert [tuple(r) for r in S.read_csv(spark, path).collect()] == [("1", 2), ("3", None), ("x,y", 5)]


def test_reordered_csv_headers_raise(spark, tmpdir_path):
    path = put(f"{tmpdir_path}/c", a_csv="a,b\n1,2\n", b_csv="b,a\n3,4\n")
    with pytest.raises(Exception):
        S.read_csv(spark, path).collect()


def test_json_columns_of_all_files(spark, tmpdir_path):
    path = put(f"{tmpdir_path}/j", a_json='{"a": {"0": 1, "1": 2}, "b": {"0": 3, "1": 4}}', b_json='{"a": {"0": 5}, "z": {"0": 6}}')
    df = S.read_json(spark, path)
    assert set(df.columns) == {"a", "b", "z"} and df.count() == 3
    assert [r["z"] for r in df.collect() if r["z"] is not None] == [6]


def test_json_lines_of_objects_with_number_keys(spark, tmpdir_path):
    path = put(f"{tmpdir_path}/j", a_json='{"a": {"0": 1}}\n{"a": {"0": 2}}\n{"a": {"0": 3}}\n')
    assert S.read_json(spark, path).count() == 3


def test_json_records_and_mixed_shapes(spark, tmpdir_path):
    one = put(f"{tmpdir_path}/r", a_json='[\n {"a": 1},\n {"a": 2}\n]', b_json='[{"a": 3}]')
    assert S.read_json(spark, one).count() == 3
    pretty = put(f"{tmpdir_path}/p", a_json='{\n "a": {\n  "0": 1,\n  "1": 2\n }\n}')
    assert S.read_json(spark, pretty).count() == 2
    mixed = put(f"{tmpdir_path}/m", a_json='[{"a": 1}]', b_json='{"a": 1}\n{"a": 2}\n')
    with pytest.raises(ValueError, match="shape"):
        S.read_json(spark, mixed)
