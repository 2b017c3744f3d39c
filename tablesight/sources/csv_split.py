"""CSV files with quoted newlines, read in parallel blocks.

A block of a file can't tell by itself whether it begins inside a quoted field.
But quotes come in pairs outside of which a line ends a record:

1. every block counts its quotes (one scan, one row a block);
2. a running total over the blocks of a file tells each whether an odd number
   of quotes lies before it, so whether it begins inside a field;
3. every block joins its own lines to records, from the state it begins in;
4. what crosses borders, at most an end and a beginning per block, is put
   together in file order.

Records are then parsed as CSV. Lines come from Spark's text source, whose
splits are the blocks; nothing is shuffled but the fragments at borders.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Blocks (24 bytes each) whose states are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000

RECORD = "file long, block long, line long, begins boolean, kind string, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, line, text)``: lines without their line feed, in file
    order within each block; file is a hash of the path."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"),
                       F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
                       F.col("value").alias("text"))


def _states(lines: DataFrame, quote: str) -> DataFrame:
    """``(file, path, block, inside, open_end)``: whether each block begins
    inside a quoted field, and whether its file ends in one."""
    quotes = F.length("text") - F.length(F.replace("text", F.lit(quote), F.lit("")))
    totals = lines.groupBy("file", "path", "block").agg(F.sum(quotes).alias("quotes"))
    w = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("quotes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("quotes").over(Window.partitionBy("file"))
    return totals.select("file", "path", "block", (before % 2 == 1).alias("inside"), (whole % 2 == 1).alias("open_end"))


def _join_lines(quote: str):
    """Joins the lines of each block to records. Kinds: whole; head, the end of
    a record begun in an earlier block; tail, a record not ended in this one.
    The first record of a file that isn't empty ``begins`` it."""
    def run(batches):
        here, odd, kind, parts, first, begins = None, False, "whole", [], 0, False
        out = []

        def close(kind):
            nonlocal begins
            text = "\n".join(parts)
            parts.clear()
            if kind != "whole" or text.rstrip("\r"):
                out.append((*here, first, begins, kind, text))
                begins = False

        def batch():
            types = [pa.int64()] * 3 + [pa.bool_(), pa.string(), pa.string()]
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["file", "block", "line", "begins", "kind", "text"])
            out.clear()
            return rows

        for b in batches:
            for file, block, line, text, inside in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != here:
                    if parts:  # still inside: an open record, or a block without an end of one
                        close("tail" if kind == "whole" else "head")
                    here, odd, begins = (file, block), inside, block == 0
                    kind = "head" if inside else "whole"
                if not parts:
                    first = line
                parts.append(text)
                odd ^= text.count(quote) % 2 == 1
                if not odd:
                    close(kind)
                    kind = "whole"
            if out:
                yield batch()
        if parts:
            close("tail" if kind == "whole" else "head")
        if out:
            yield batch()
    return run


def csv_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(file, block, line, begins, text)``: the records of the CSV files at
    ``path``, quoted newlines kept; (file, block, line) orders the records of a
    file, ``begins`` marks its first. They are written once to the shared folder,
    as finding the header, the types and the rows read them again.

    Quotes inside a field must be doubled and fields that hold quotes quoted,
    else records are joined wrongly. Lines end in \\n or \\r\\n. Empty lines
    between records are left out. A file that ends inside a field raises.
    """
    lines = _lines(spark, path)
    states = materialize(_states(lines, quote), "csv-blocks")
    bad = states.filter("open_end").select("path").first()
    if bad:
        raise ValueError(f"{bad[0]} ends inside a quoted field")
    states = states.select("file", "block", "inside")
    if states.count() <= MAX_BROADCAST:
        known = lines.join(F.broadcast(states), ["file", "block"])
    else:
        known = lines.join(states, ["file", "block"]).sortWithinPartitions("file", "block", "line")
    known = known.select("file", "block", "line", "text", "inside")
    joined = materialize(known.mapInArrow(_join_lines(quote), RECORD), "csv-records")
    records = joined.filter("kind = 'whole'").drop("kind")
    # Two rows a block at most: a tail begins a record, heads continue it.
    pieces = joined.filter("kind <> 'whole'")
    w = Window.partitionBy("file").orderBy("block", "line")
    pieces = pieces.withColumn("record", F.count_if(F.col("kind") == "tail").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("block", "line", "begins", "text")))
    mended = pieces.groupBy("file", "record").agg(ordered.alias("parts")).select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["line"].alias("line"), F.col("parts")[0]["begins"].alias("begins"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    records = records.unionByName(mended).withColumn("text", F.regexp_replace("text", "\r$", ""))
    return records


def read_csv_split(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> tuple[list[str], DataFrame]:
    """Header names, and rows of text columns ``c0``, ``c1``... with one more
    column for what a row has beyond the header. Every file begins with a
    header, all with the same one, else reading raises."""
    records = csv_records(spark, path, quote)
    first = records.filter("begins").select("text").distinct().limit(2).collect()
    if not first:
        return [], spark.createDataFrame([], "c0 string")
    if len(first) > 1:
        raise ValueError(f"CSV files with different headers: {first[0][0]!r} and {first[1][0]!r}")
    names = next(csv.reader(io.StringIO(first[0][0]), delimiter=sep, quotechar=quote))
    schema = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    form = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true"}
    return names, records.filter("NOT begins").select(F.from_csv("text", schema, form).alias("r")).select("r.*")
