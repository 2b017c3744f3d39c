"""Workbooks: dates by number format, both date systems, names, odd cells."""

from __future__ import annotations

from datetime import datetime

import pytest

from tablesight.plans.inputs import _SHEETS, _XML, workbook
from tablesight.sources import read_dataset, read_workbooks
from tablesight.sources.readers import NA_TOKENS
from tablesight.sources.workbooks import is_date_format


def books(spark, *contents):
    rows = [(f"b{i}.xlsx", c) for i, c in enumerate(contents)]
    return read_workbooks(spark.createDataFrame(rows, "path string, content binary"), NA_TOKENS)


def sheet(body, **extra):
    more = {"xl/worksheets/sheet1.xml": f'{_XML}<worksheet xmlns="{_SHEETS}"><sheetData>{body}</sheetData></worksheet>'}
    return workbook([], [], {**more, **{f"xl/{k}.xml": v for k, v in extra.items()}})


@pytest.mark.parametrize("code, date", [
    ("yyyy\\-mm\\-dd", True), ("General", False), ("0.00", False), ("[h]:mm", False), ("h:mm AM/PM", True), ('0" days"', False),
    ("[Red]0.0", False), ("[$-409]d mmm yy;@", True), ("0.00E+00", False), ("#,##0_)", False)])
def test_date_formats(code, date):
    assert is_date_format(code) == date


def test_dates_are_timestamps(spark):
    cells = "".join(f'<row><c s="1"><v>{x}</v></c><c><v>{x}</v></c></row>' for x in ("1", "59", "61", "45292.5", "45292.000011574"))
    df = books(spark, sheet('<row><c t="inlineStr"><is><t>d</t></is></c><c t="inlineStr"><is><t>n</t></is></c></row>' + cells))
    assert dict(df.dtypes) == {"d": "timestamp_ntz", "n": "double"}
    assert [r.d for r in df.collect()] == [datetime(1900, 1, 1), datetime(1900, 2, 28), datetime(1900, 3, 1), datetime(2024, 1, 1, 12),
                                           datetime(2024, 1, 1, 0, 0, 1)]


def test_other_date_system_and_written_dates(spark):
    mac = (f'{_XML}<workbook xmlns="{_SHEETS}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
           '<workbookPr date1904="1"/><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
    head = '<row><c t="inlineStr"><is><t>d</t></is></c></row>'
    df = books(spark, sheet(head + '<row><c s="1"><v>0</v></c></row><row><c t="d"><v>2020-02-03T04:05:06</v></c></row>', workbook=mac))
    assert [r.d for r in df.collect()] == [datetime(1904, 1, 1), datetime(2020, 2, 3, 4, 5, 6)]


def test_mixed_columns_times_and_errors(spark):
    head = "".join(f'<c t="inlineStr"><is><t>{n}</t></is></c>' for n in ("mixed", "time", "bad", "flag"))
    df = books(spark, sheet(f'<row>{head}</row><row><c s="1"><v>45292</v></c><c s="1"><v>0.25</v></c><c t="e"><v>#DIV/0!</v></c><c t="b"><v>1</v></c></row>'
                            '<row><c t="inlineStr"><is><t>soon</t></is></c><c/><c><v>2</v></c><c t="b"><v>0</v></c></row>'))
    assert dict(df.dtypes) == {"mixed": "string", "time": "string", "bad": "bigint", "flag": "boolean"}
    assert [tuple(r) for r in df.collect()] == [("2024-01-01 00:00:00", "06:00:00", None, True), ("soon", None, 2, False)]


def test_books_match_by_name(spark):
    df = books(spark, workbook(["a", "b", "a"], [(1, "x", 2), (3, None, 4)]), workbook(["b", "c"], [("NA", 1.5), ("z", 2.5, 9)]), workbook([], []))
    assert df.columns == ["a", "b", "c", "Unnamed: 2", "a.1"]
    assert [tuple(r) for r in df.select("a", "b", "c", "`a.1`", "`Unnamed: 2`").collect()] == [(1, "x", None, 2, None), (3, None, None, 4, None), (None, None, 1.5, None, None),
                                                (None, "z", 2.5, None, 9)]


def test_rows_and_cells_by_reference(spark):
    df = books(spark, sheet('<row r="1"><c r="B1" t="inlineStr"><is><r><t>ri</t></r><r><t>ch</t></r><rPh><t>!</t></rPh></is></c></row>'
                            '<row r="4"><c r="B4"><v>7</v></c><c r="AA4"><v>8</v></c></row>'))
    assert df.columns == ["rich", "Unnamed: 26"] and [tuple(r) for r in df.collect()] == [(7, 8)]


def test_no_cells_null_contents_and_files(spark, tmp_path):
    df = spark.createDataFrame([("x", None)], "path string, content binary")
    assert read_workbooks(df, NA_TOKENS).columns == [] and books(spark, workbook([], [])).columns == []
    (tmp_path / "one.xlsx").write_bytes(workbook(["k"], [(i,) for i in range(12_000)]))
    (tmp_path / "two.xlsx").write_bytes(workbook(["k"], [(i,) for i in range(12_000, 12_010)]))
    got = read_dataset(spark, str(tmp_path), fmt="xlsx")
    assert [r.k for r in got.collect()] == list(range(12_010))
