"""Excel workbooks (.xlsx) as a table: the first sheet of each, header row
first, dates told by their number format.

The bytes come from Spark's ``binaryFile`` source, so workbooks may lie in any
store that Spark reads. One task streams a workbook's sheet row by row; its
rows leave the task already named by the workbook's own header, so no cell is
shuffled and nothing is pivoted. With them goes one summary row a workbook
(columns, and how many of their cells are dates), which is all that the schema
needs. The parsed rows are written once to the shared checkpoint folder, as
types, schema and result read them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Names of the format's XML, its built-in date and time formats
# (those with elapsed time left out), the first day of its two date systems.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 47, *range(50, 59)}
DAY_0, DAY_0_MAC = datetime(1899, 12, 30), datetime(1904, 1, 1)

#: Rows of a sheet that leave a task together.
BATCH = 5_000
ROWS = "path string, row int, cells map<string,string>, columns array<struct<name: string, at: int, present: long, dates: long>>"


def is_date_format(code: str) -> bool:
    """A number format that shows a date or a time of day. Elapsed time
    ([h]:mm) is a number."""
    if re.search(r"\[(h+|m+|s+)\]", code, re.IGNORECASE):
        return False
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]', "", code).split(";")[0].lower()
    return "general" not in bare and bool(re.search("[ymdhs]", bare))


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    """Per cell style, whether it shows dates."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): is_date_format(f.get("formatCode") or "") for f in root.iter(f"{_MAIN}numFmt")}
    ids = [int(x.get("numFmtId") or 0) for x in root.findall(f"{_MAIN}cellXfs/{_MAIN}xf")]
    return [own.get(i, i in DATE_FORMATS) for i in ids]


def _text(node: ET.Element) -> str:
    """Plain and rich text of a string; its phonetic readings are left out."""
    parts = node.findall(f"{_MAIN}t") + [t for r in node.findall(f"{_MAIN}r") for t in r.findall(f"{_MAIN}t")]
    return "".join(t.text or "" for t in parts)


def _column(ref: str | None, before: int) -> int:
    letters = re.match(r"[A-Z]+", ref or "")
    if not letters:
        return before + 1
    n = 0
    for ch in letters.group(0):
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _when(serial: str, mac: bool) -> tuple[str, bool]:
    """A serial number as text, and whether it is a date: days below 1 are
    times of day; 1900 counts as a leap year, so days below 60 are one later;
    milliseconds are the unit. What no calendar holds stays a number."""
    x = float(serial)
    if not 0 <= x < 2_958_466:
        return serial, False
    shift = 0 if mac or x >= 60 else 1
    when = (DAY_0_MAC if mac else DAY_0) + timedelta(days=int(x) + shift, milliseconds=round((x - int(x)) * 86_400_000))
    if x < 1 and not mac:
        return str(when.time()), False
    return str(when), True


def _sheet(content: bytes) -> Iterator[tuple[int, list[tuple[int, str | None, bool]]]]:
    """(row number, [(column, text, is a date)]) of the first sheet, streamed.
    Errors are null."""
    z = zipfile.ZipFile(io.BytesIO(content))
    book = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = book.find(f"{_MAIN}sheets/{_MAIN}sheet")
    props = book.find(f"{_MAIN}workbookPr")
    mac = props is not None and props.get("date1904") in ("1", "true")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in rels.findall(f"{_PACKAGE}Relationship")}
    target = targets.get(sheet.get(_REL_ID), "worksheets/sheet1.xml") if sheet is not None else None
    if target is None:
        return
    dates, shared = _date_styles(z), []
    if "xl/sharedStrings.xml" in z.namelist():
        for _, node in ET.iterparse(z.open("xl/sharedStrings.xml")):
            if node.tag == f"{_MAIN}si":
                shared.append(_text(node))
                node.clear()
    at, data = -1, None
    for event, row in ET.iterparse(z.open(target if target.startswith("xl/") else "xl/" + target), ("start", "end")):
        if event == "start" and row.tag == f"{_MAIN}sheetData":
            data = row
        if event == "start" or row.tag != f"{_MAIN}row":
            continue
        at, place, cells = int(row.get("r", at + 2)) - 1, -1, []
        for c in row.findall(f"{_MAIN}c"):
            place = _column(c.get("r"), place)
            kind, style = c.get("t", "n"), int(c.get("s") or 0)
            value = c.findtext(f"{_MAIN}v")
            date = False
            if kind == "inlineStr":
                inner = c.find(f"{_MAIN}is")
                value = _text(inner) if inner is not None else None
            elif value is None or kind == "e":
                value = None
            elif kind == "s":
                value = shared[int(value)]
            elif kind == "b":
                value = "true" if value == "1" else "false"
            elif kind == "d":
                value, date = value.replace("T", " "), True
            elif kind == "n" and style < len(dates) and dates[style]:
                value, date = _when(value, mac)
            cells.append((place, value, date))
        data.clear()
        yield at, cells


def _rows(path: str, content: bytes, missing: frozenset) -> Iterator[tuple]:
    """Rows of a workbook by name, then its summary (row -1)."""
    from .readers import dedupe_names
    names, seen = {}, {}
    for at, cells in _sheet(content):
        if at == 0:
            head = sorted((c, v) for c, v, _ in cells if v is not None)
            names = dict(zip([c for c, _ in head], dedupe_names([v for _, v in head])))
            seen = {c: [0, 0] for c in names}
            continue
        out = {}
        for c, value, date in cells:
            if c not in names:
                names[c] = dedupe_names([*names.values(), f"Unnamed: {c}"])[-1]
            name = names[c]
            count = seen.setdefault(c, [0, 0])
            if value is not None and value not in missing:
                count[0] += 1
                count[1] += date
            out[name] = value
        yield path, at, list(out.items()), None
    yield path, -1, None, [{"name": names[c], "at": c, "present": p, "dates": d} for c, (p, d) in sorted(seen.items())]


def read_workbooks(files: DataFrame, na_tokens: Sequence[str]) -> DataFrame:
    """One table of the first sheets of all workbooks in ``files`` (path,
    content), in order of path and row.

    Columns are matched by name; a workbook without one has nulls there. A
    column is a timestamp (without zone) if all its present cells are dates;
    where dates and others mix, dates are text. Times of day are text,
    elapsed times numbers, errors and missing tokens null. Other types are
    inferred as for CSV. Empty rows between others are rows of nulls if the
    sheet holds them. Workbooks without cells give no rows; null contents are
    skipped.
    """
    from .readers import infer_types, normalize_missing
    missing = frozenset(na_tokens)

    def parse(batches):
        schema = pa.schema([("path", pa.string()), ("row", pa.int32()), ("cells", pa.map_(pa.string(), pa.string())),
                            ("columns", pa.list_(pa.struct([("name", pa.string()), ("at", pa.int32()), ("present", pa.int64()), ("dates", pa.int64())])))])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                if not content.is_valid:
                    continue
                part = []
                for row in _rows(path.as_py(), content.as_py(), missing):
                    part.append(row)
                    if len(part) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    parsed = materialize(files.select("path", "content").mapInArrow(parse, ROWS), "workbooks")
    summary = parsed.filter("row = -1").select(F.inline("columns"))
    # One row per column: the schema is needed on the driver.
    columns = (summary.groupBy("name").agg(F.min("at").alias("at"), F.sum("present").alias("present"), F.sum("dates").alias("dates"))
               .orderBy("at", "name").collect())
    rows = parsed.filter("row > 0").orderBy("path", "row")
    wide = normalize_missing(rows.select(*[F.element_at("cells", F.lit(c["name"])).alias(c["name"]) for c in columns]), na_tokens)
    dates = {c["name"] for c in columns if c["dates"] and c["dates"] == c["present"]}
    wide = wide.withColumns({c: F.col(f"`{c}`").cast("timestamp_ntz") for c in dates}) if dates else wide
    return infer_types(wide, [c for c in wide.columns if c not in dates])
