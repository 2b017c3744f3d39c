"""Readers: written-then-read files in a scratch folder (CSV, JSON in three
shapes, Excel, Parquet) and format dispatch."""

import os
import zipfile

import pytest

from tablesight.sources import readers as S
from tablesight.sources import sinks as K

CSV = 'a,b,c,d,a\n1,NA,"x, ""q""",n/a,5\n2,None,"multi\nline",3.5,6\n3,null,z,,7\n'


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    return path


def test_csv_tokens_types_and_duplicate_headers(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "t.csv"), CSV)
    df = S.read_dataset(spark, p, multiline=True)
    assert df.columns == ["a", "b", "c", "d", "a.1"]
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(1, None, 'x, "q"', None, 5), (2, None, "multi\nline", 3.5, 6), (3, None, "z", None, 7)]
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "double", "a.1": "bigint"}


def test_type_decisions_bool_and_text(spark):
    df = spark.createDataFrame([("true", "1", "x"), ("False", "2.5", "1"), (None, "1e3", "2")],
                               "p string, q string, r string")
    dec = {r["column"]: r["dtype"] for r in S.type_decisions(df).collect()}
    assert dec == {"p": "boolean", "q": "double", "r": "string"}


def test_json_three_shapes_same_rows(spark, tmpdir_path):
    rec = write(os.path.join(tmpdir_path, "r.json"), '[{"a": 1, "d": {"x": 1}}, {"a": 2, "d": {"x": 2}}]')
    col = write(os.path.join(tmpdir_path, "c.json"), '{"a": {"0": 1, "1": 2}}')
    lin = write(os.path.join(tmpdir_path, "l.jsonl"), '{"a": 1, "d": {"x": 1}}\n{"a": 2, "d": {"x": 2}}\n')
    r = S.read_dataset(spark, rec)
    c = S.read_dataset(spark, col)
    ln = S.read_dataset(spark, lin)
    assert sorted(x["a"] for x in r.collect()) == sorted(x["a"] for x in c.collect()) == \
        sorted(x["a"] for x in ln.collect()) == [1, 2]
    assert sorted(x["d"]["x"] for x in r.collect()) == [1, 2] == sorted(x["d"]["x"] for x in ln.collect())


def _xlsx(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>name</t></si><si><t>qty</t></si><si><t>apple</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>'
                   '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
                   '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>3</v></c></row>'
                   '<row r="3"><c r="A3" t="inlineStr"><is><t>pear</t></is></c><c r="B3"><v>4.5</v></c></row>'
                   '</sheetData></worksheet>')
    return path


def test_excel_first_sheet(spark, tmpdir_path):
    p = _xlsx(os.path.join(tmpdir_path, "b.xlsx"))
    df = S.read_dataset(spark, p)
    assert df.columns == ["name", "qty"]
    assert sorted(tuple(r) for r in df.collect()) == [("apple", 3.0), ("pear", 4.5)]


def test_parquet_and_format_label(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "p.parquet")
    spark.range(5).write.parquet(p)
    df = S.read_dataset(spark, p)
    assert df.count() == 5
    assert {r[0] for r in df.select(S.format_label()).collect()} == {"PARQUET"}


def test_unsupported_extension(spark):
    with pytest.raises(ValueError, match="no reader"):
        S.read_dataset(spark, "/x/y.txt")


def test_write_results_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    (p,) = K.write_results({"t": df}, tmpdir_path, "json")
    assert spark.read.json(p).count() == 1


def test_json_date_like_columns(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "d.jsonl"),
              '{"created_at": "2024-01-02 03:04:05", "note": "2024-01-02", "date": "soon"}\n'
              '{"created_at": "2024-02-03T00:00:00", "note": "x", "date": "later"}\n')
    df = S.read_dataset(spark, p)
    types = dict(df.dtypes)
    assert types["created_at"] == "timestamp" and types["note"] == "string" and types["date"] == "string"


def test_csv_folder_of_files(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "many")
    os.makedirs(d)
    for i in range(3):
        write(os.path.join(d, f"part{i}.csv"), "k,v,flag\n" + "".join(f"{i * 10 + j},{j}.5,{'true' if j % 2 else 'false'}\n"
                                                               for j in range(4)))
    df = S.read_dataset(spark, d, fmt="csv")
    assert dict(df.dtypes) == {"k": "bigint", "v": "double", "flag": "boolean"}
    assert df.count() == 12 and sorted(r["k"] for r in df.collect())[:3] == [0, 1, 2]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_write_results_formats(spark, tmpdir_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    (p,) = K.write_results({"t": df}, os.path.join(tmpdir_path, fmt), fmt)
    back = S.read_dataset(spark, p, fmt=fmt)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, "b")]
