"""Driver tables and derived inputs.

Derived inputs are SQL text shared by Spark and the oracle engine, so both
sides start from the same rows. ``{name}`` placeholders name base tables;
Spark binds them to DataFrames, the oracle to its views.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DERIVED = {
    # missing cells and duplicate rows
    "dirty_orders": """
        with d as (
          select o_orderkey, o_custkey, o_orderstatus,
                 case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice,
                 o_orderdate,
                 case when o_orderkey % 5 = 0 then null else o_orderpriority end as o_orderpriority
          from {orders})
        select * from d union all select * from d where o_orderkey % 10 = 0""",
    "pair_a": "select * from {orders} where o_orderkey % 2 = 0",
    "pair_b": """
        select o_orderkey, cast(o_custkey as string) as o_custkey, o_orderstatus, o_totalprice,
               o_orderdate, o_totalprice / 2 as o_half
        from {orders} where o_orderkey % 2 = 1""",
    "skewed": "select event_id, exp(value / 100) as x from {events}",
    "constant": "select *, cast(1.0 as double) as k from {part}",
    "leaky": "select *, o_totalprice * 1.1 as leak from {orders}",
    "classification": """
        select d.doc_id, d.n_chars, d.lang, d.source, l.quality, l.toxic
        from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "regression": """
        select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice
        from {lineitem}""",
    # every column as text, with missing-value spellings put in by key
    "text_orders": """
        select cast(o_orderkey as string) as o_orderkey,
               case when o_orderkey % 11 = 0 then 'NA' else cast(o_custkey as string) end as o_custkey,
               case when o_orderkey % 13 = 0 then 'n/a' else o_orderstatus end as o_orderstatus,
               case when o_orderkey % 17 = 0 then '' else cast(round(o_totalprice, 2) as string) end as o_totalprice,
               case when o_orderkey % 19 = 0 then 'null' else cast(cast(o_orderdate as date) as string) end as o_orderdate,
               case when o_orderkey % 23 = 0 then 'NA' else o_orderpriority end as o_orderpriority,
               case when o_orderkey % 3 = 0 then 'true' when o_orderkey % 29 = 0 then 'None' else 'false' end as o_flag
        from {orders}""",
}

NEEDS = {k: [t for t in TABLES if "{" + t + "}" in v] for k, v in DERIVED.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived input at ``sf_dir``."""
    if name in DERIVED:
        frames = {t: table(spark, sf_dir, t) for t in NEEDS[name]}
        return spark.sql(DERIVED[name], **frames)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def oracle_from(*names: str) -> str:
    """``with`` clause defining the derived inputs for the oracle engine."""
    parts = []
    for n in names:
        body = DERIVED[n].format(**{t: t for t in TABLES})
        parts.append(f"{n} as ({body})")
    return "with " + ",\n".join(parts) + "\n" if parts else ""


#: Keys per workbook of the stand-in workbooks: their number grows with the table.
BOOK_KEYS = 4096
_XML = '<?xml version="1.0" encoding="UTF-8"?>'
_SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_BOOK = {
    "xl/workbook.xml": f'{_XML}<workbook xmlns="{_SHEETS}" xmlns:r="{_OFFICE}"><sheets><sheet name="rows" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'{_XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                  f'<Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/styles.xml": f'{_XML}<styleSheet xmlns="{_SHEETS}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd\\ hh:mm"/></numFmts>'
                     '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
}


def workbook(names: list[str], rows: list[tuple], extra: dict[str, str] | None = None) -> bytes:
    """A workbook of one sheet: numbers, texts, datetimes (style 1); nulls have no cell."""
    def cell(v) -> str:
        if pd.isna(v):
            return "<c/>"
        if isinstance(v, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        if isinstance(v, pd.Timestamp):
            return f'<c s="1"><v>{(v - pd.Timestamp("1899-12-30")) / pd.Timedelta(days=1)!r}</v></c>'
        return f"<c><v>{v!r}</v></c>"

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(names), *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {**_BOOK, "xl/worksheets/sheet1.xml": f'{_XML}<worksheet xmlns="{_SHEETS}"><sheetData>{body}</sheetData></worksheet>',
                           **(extra or {})}.items():
            z.writestr(name, text)
    return out.getvalue()


def workbooks(df: DataFrame, key: str) -> DataFrame:
    """``(path, content)`` as Spark's binaryFile source gives them: the rows of
    ``df`` as workbooks of BOOK_KEYS consecutive values of ``key`` each."""
    names = df.columns

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        book = pdf.pop("_book").iat[0]
        rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in pdf.itertuples(index=False, name=None)]
        return pd.DataFrame({"path": [f"book-{book:012d}.xlsx"], "content": [workbook(names, rows)]})

    return df.withColumn("_book", F.floor(F.col(key) / BOOK_KEYS)).groupBy("_book").applyInPandas(build, "path string, content binary")
