"""Sinks: result tables as JSON/Parquet/CSV, the profile text, the HTML
report and per-conversation Markdown exports.

Line tables are written in order with ``repartitionByRange`` +
``sortWithinPartitions`` (a distributed sort), never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.conversations import EXPORT_SEPARATOR, markdown_blocks


def write_results(dfs: dict[str, DataFrame], path: str, fmt: str = "json", mode: str = "overwrite") -> list[str]:
    """Write each named result under ``path/<name>`` in ``fmt``."""
    out = []
    for name, df in dfs.items():
        p = f"{path.rstrip('/')}/{name}"
        w = df.write.mode(mode)
        (w.option("header", True).csv(p) if fmt == "csv" else getattr(w, fmt)(p))
        out.append(p)
    return out


def write_lines(lines: DataFrame, path: str, order: list[str], text: str = "line") -> None:
    """Write a line table as text files in ``order`` (one ordered run of
    files; read them in name order)."""
    (lines.repartitionByRange(*order).sortWithinPartitions(*order).select(text)
          .write.mode("overwrite").text(path))


def write_profile_text(lines: DataFrame, path: str) -> None:
    """K2: the profile text from ``profile_text_lines``."""
    write_lines(lines, path, ["section", "ordinal"])


def write_report_html(lines: DataFrame, path: str) -> None:
    """K3: the HTML page from ``report_html``."""
    write_lines(lines.coalesce(1), path, ["ordinal"])


def write_chat_exports(conv: DataFrame, path: str) -> None:
    """K4: one Markdown export per conversation under ``conv_id=<id>/``.
    Blocks are separated by the export separator; rows of one conversation
    go to one task (partitioned by conversation), in turn order."""
    blocks = markdown_blocks(conv)
    sep = EXPORT_SEPARATOR.replace("\n", "", 1)  # newline between rows comes from the text writer
    text = F.when(F.col("seq") < 0, F.col("block")).otherwise(F.concat(F.lit(sep), F.col("block")))
    (blocks.select("conv_id", "seq", text.alias("value"))
           .repartition("conv_id").sortWithinPartitions("conv_id", "seq")
           .drop("seq").write.mode("overwrite").partitionBy("conv_id").text(path))
