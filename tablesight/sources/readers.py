"""Loading tables: dispatch by extension, CSV with missing-token
normalisation and type inference, JSON in three shapes, Excel workbooks,
Parquet.

CSV and JSON Lines split across tasks; a multi-line CSV, a single JSON
document or a workbook is read by one task per file, so many files beat one
big file. Type inference is one aggregate over the data; only the chosen
types (one row) reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from .csv_split import read_csv_split
from .workbooks import read_workbooks

SUPPORTED = (".csv", ".xlsx", ".json", ".jsonl", ".parquet")

# Text that counts as missing in CSV input (pandas' default list).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

INT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|[iI]nf|[iI]nfinity)\s*$"


def _ext(path: str) -> str:
    m = re.search(r"(\.[^./\\]+)$", path.rstrip("/"))
    return m.group(1).lower() if m else ""


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, **opts) -> DataFrame:
    """Read a file, folder or glob by format (from ``fmt`` or the lower-cased
    extension)."""
    ext = ("." + fmt.lower().lstrip(".")) if fmt else _ext(path)
    if ext == ".csv":
        return read_csv(spark, path, **opts)
    if ext == ".xlsx":
        return read_excel(spark, path, **opts)
    if ext in (".json", ".jsonl"):
        return read_json(spark, path, shape="lines" if ext == ".jsonl" else opts.pop("shape", "auto"), **opts)
    if ext == ".parquet":
        return read_parquet(spark, path)
    raise ValueError(f"no reader for files ending in {ext!r}; known endings: {' '.join(SUPPORTED)}")


def format_label(path_col: str | None = None) -> F.Column:
    """Upper-cased extension of each row's source file."""
    src = F.col(path_col) if path_col else F.input_file_name()
    return F.upper(F.regexp_extract(src, r"\.([^./]+)$", 1))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------- CSV

def dedupe_names(names: Sequence[str]) -> list[str]:
    """Repeated header names get ``.1``, ``.2``... in order (pandas style)."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = "Unnamed" if n is None else n
        if n in seen:
            seen[n] += 1
            m = f"{n}.{seen[n]}"
            while m in seen:
                seen[n] += 1
                m = f"{n}.{seen[n]}"
            seen[m] = 0
            out.append(m)
        else:
            seen[n] = 0
            out.append(n)
    return out


def read_csv(spark: SparkSession, path: str, multiline: bool | str = False, infer: bool = True,
             na_tokens: Sequence[str] = NA_TOKENS, sep: str = ",") -> DataFrame:
    """Header row, doubled quotes, optional quoted newlines: ``multiline="split"``
    reads files in parallel blocks (``csv_split``), True makes each file one
    task. All columns are read as text, missing tokens
    become null, then types are inferred (int -> float -> bool -> text).

    A row with fewer fields than the header ends in nulls; one with more
    fields raises when it is read. Files of a folder must have the same header
    in the same order, else reading raises (unless the header repeats names,
    which Spark cannot check).
    """
    if multiline == "split":
        header, df = read_csv_split(spark, path, sep)
        message = F.concat(F.lit("CSV row with more fields than the header, at "), F.coalesce(F.col("c0"), F.lit("")))
        if header:
            more = F.col(f"c{len(header)}")
            df = df.filter(F.when(more.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True)).drop(f"c{len(header)}")
            df = df.toDF(*dedupe_names(header))
        df = normalize_missing(df, na_tokens)
        return infer_types(df) if infer else df
    form = {"multiLine": multiline, "escape": '"', "quote": '"', "sep": sep}
    first = spark.read.options(header=False, **form).csv(path).limit(1).collect()
    if not first:
        return spark.read.options(header=True, **form).csv(path)
    header = [v if v is not None else "" for v in first[0]]
    names = dedupe_names(header)
    raw = "_raw_row"
    while raw in names:
        raw += "_"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, raw]])
    df = (spark.read.options(header=True, enforceSchema=names != header, mode="PERMISSIVE", columnNameOfCorruptRecord=raw, **form)
          .schema(schema).csv(path))
    wide = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    more = F.from_csv(F.col(raw), wide, {"sep": sep, "escape": '"', "quote": '"'})[f"c{len(names)}"]
    # The message names the first field too: Spark refuses to read the raw row alone.
    message = F.concat(F.lit("CSV row with more fields than the header, at "), F.coalesce(col(names[0]), F.lit("")), F.lit(": "), F.col(raw))
    df = df.filter(F.when(more.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True)).drop(raw)
    df = normalize_missing(df, na_tokens)
    return infer_types(df) if infer else df


def normalize_missing(df: DataFrame, tokens: Sequence[str] = NA_TOKENS,
                      cols: Sequence[str] | None = None) -> DataFrame:
    """Text cells equal to one of ``tokens`` become null, in one select."""
    cols = set(cols) if cols is not None else {f.name for f in df.schema.fields
                                               if isinstance(f.dataType, T.StringType)}
    toks = list(tokens)
    return df.select(*[F.when(col(c).isin(toks), F.lit(None).cast("string")).otherwise(col(c)).alias(c)
                       if c in cols else col(c) for c in df.columns])


def type_decisions(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(ordinal, column, dtype)``: the type each text column converts to,
    from one aggregate: bigint if every present value is an integer, double
    if every one is a number, boolean if every one is true/false, else
    string; an all-missing column is double."""
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields
                                                if isinstance(f.dataType, T.StringType)]
    pos = {c: i for i, c in enumerate(df.columns)}
    aggs = []
    for c in cols:
        v = col(c)
        aggs += [F.count(v).alias(f"p{pos[c]}"),
                 F.count_if(v.rlike(INT_PATTERN) & F.trim(v).try_cast("bigint").isNotNull()).alias(f"i{pos[c]}"),
                 F.count_if(v.rlike(FLOAT_PATTERN) & F.trim(v).try_cast("double").isNotNull()).alias(f"f{pos[c]}"),
                 F.count_if(F.lower(F.trim(v)).isin("true", "false")).alias(f"b{pos[c]}")]
    if not cols:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, dtype string")
    st = df.agg(*aggs)
    rows = []
    for c in cols:
        i = pos[c]
        p, n_i, n_f, n_b = (F.col(f"{k}{i}") for k in "pifb")
        dt = (F.when(p == 0, "double").when(n_i == p, "bigint").when(n_f == p, "double")
               .when(n_b == p, "boolean").otherwise("string"))
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), dt.alias("dtype")))
    return st.select(F.inline(F.array(*rows)))


def _convert(c: str, dtype: str) -> F.Column:
    v = F.trim(col(c))
    if dtype == "bigint":
        return v.try_cast("bigint").alias(c)
    if dtype == "double":
        low = F.lower(v)
        return (F.when(low.isin("inf", "infinity", "+inf", "+infinity"), F.lit(float("inf")))
                 .when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
                 .otherwise(v.try_cast("double")).alias(c))
    if dtype == "boolean":
        return (F.lower(v) == "true").alias(c)
    return col(c)


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Convert text columns to the types chosen by ``type_decisions`` (one
    small row read on the driver to fix the schema)."""
    dec = {r["column"]: r["dtype"] for r in type_decisions(df, cols).collect()}
    return df.select(*[_convert(c, dec[c]) if c in dec else col(c) for c in df.columns])


# ---------------------------------------------------------------- JSON

def is_date_like(name: str) -> bool:
    """Column names treated as dates in JSON input (pandas' default rule)."""
    low = name.lower()
    return (low.endswith("_at") or low.endswith("_time") or low.startswith("timestamp")
            or low in ("modified", "date", "datetime"))


def parse_date_like(df: DataFrame) -> DataFrame:
    """Text columns with date-like names become timestamps when every present
    value parses (ISO forms); others are left as they are. One aggregate
    decides, then one select converts."""
    cand = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and is_date_like(f.name)]
    if not cand:
        return df
    ok = df.agg(*[F.expr(f"count({col_sql}) = count(try_to_timestamp({col_sql}))").alias(f"_{i}")
                  for i, col_sql in enumerate("`" + c.replace("`", "``") + "`" for c in cand)]).first()
    conv = {c for i, c in enumerate(cand) if ok[f"_{i}"]}
    return df.select(*[F.expr(f"try_to_timestamp(`{c}`)").alias(c) if c in conv else col(c) for c in df.columns])


def read_json(spark: SparkSession, path: str, shape: str = "auto", parse_dates: bool = True) -> DataFrame:
    """See ``_read_json``; text columns with date-like names are parsed as
    timestamps when all their values parse."""
    df = _read_json(spark, path, shape)
    return parse_date_like(df) if parse_dates else df


def _read_json(spark: SparkSession, path: str, shape: str = "auto") -> DataFrame:
    """``records`` (one array of objects per file), ``columns`` (one object
    of column -> {index -> value}), or ``lines`` (one object per line, the
    splittable form). ``auto`` decides from all files and raises if they
    differ in shape."""
    if shape == "auto":
        shape = _json_shape(spark, path)
    if shape == "records":
        return spark.read.option("multiLine", True).json(path)
    if shape == "lines":
        return spark.read.json(path)
    if shape == "columns":
        whole = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
        m = whole.select("_file", F.from_json("value", "map<string,map<string,string>>").alias("m"))
        cells = (m.select("_file", F.posexplode("m").alias("place", "column", "cells"))
                  .select("_file", "place", "column", F.explode("cells").alias("idx", "value")))
        # Columns of all files: by their place in the files, then by name.
        order = [r["column"] for r in m.select(F.posexplode("m").alias("place", "column", "cells"))
                 .groupBy("column").agg(F.min("place").alias("place")).orderBy("place", "column").collect()]
        wide = (cells.groupBy("_file", F.col("idx").cast("long").alias("_idx"))
                     .pivot("column", order).agg(F.first("value")))
        return infer_types(wide.orderBy("_file", "_idx").drop("_file", "_idx"))
    raise ValueError(f"unknown JSON shape {shape!r}")


def _json_shape(spark: SparkSession, path: str) -> str:
    """Lines are told by a pass over the text lines: each is a whole object.
    A file of one line that is an object of objects is column-oriented. What
    is left is not splittable anyway: its first character decides."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("_file", F.input_file_name())
    obj = F.trim("value").startswith("{") & F.trim("value").endswith("}") & F.from_json("value", "map<string,string>").isNotNull()
    nested = obj & F.coalesce(F.forall(F.map_values(F.from_json("value", "map<string,string>")), lambda v: v.startswith("{")), F.lit(False))
    files = lines.groupBy("_file").agg(F.count("*").alias("n"), F.bool_and(obj).alias("objects"), F.bool_and(nested).alias("nested"))
    kind = F.when(F.col("objects"), F.when((F.col("n") == 1) & F.col("nested"), "columns").otherwise("lines"))
    kinds = {r["kind"] for r in files.select(kind.alias("kind")).distinct().collect()}
    if None in kinds:
        first = spark.read.text(path, wholetext=True).select(F.ltrim(F.regexp_replace("value", r"^\s+", "")).substr(1, 1).alias("c"))
        starts = {r["c"] for r in first.filter("c <> ''").distinct().collect()}
        if starts == {"["}:
            return "records"
        if starts == {"{"} and kinds <= {None, "columns"}:
            return "columns"
        raise ValueError("the files differ in JSON shape; read each shape by itself")
    if len(kinds) > 1:
        raise ValueError("the files differ in JSON shape; read each shape by itself")
    return kinds.pop() if kinds else "lines"


# ---------------------------------------------------------------- Excel (S3)

def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of each workbook of a file, folder or glob, header row
    first, dates as timestamps: one workbook per task (``workbooks``)."""
    return read_workbooks(spark.read.format("binaryFile").load(path), NA_TOKENS)
