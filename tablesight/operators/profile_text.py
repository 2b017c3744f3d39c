"""The profile text (four sections) and the HTML report as line tables.

Each section is built from small result tables (one row per column, or the
first rows), so the text is bounded by the column count; nothing scans the
data outside the profile operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, col, datetime_columns, numeric_columns
from .profile import sample_head
from .report import report_alerts, report_overview, report_variables

SECTIONS = ("Dataset Info", "Missing Values", "Statistical Summary", "Sample Data (first 5 rows)")


def _num(c: str) -> F.Column:
    return F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("NaN"))


def _cell(c: str, dt) -> F.Column:
    if dt.typeName().startswith("timestamp"):
        return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")
    return col(c).cast("string")


def profile_sections(df: DataFrame, order_by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """``(section, ordinal, line)``: info lines, missing counts (or "No
    missing values."), one describe line per column, and the first 5 rows.
    Sections 1-3 come from one scan (the shared distinct-value table)."""
    from .shared import column_counts, describe_shared, missing_from_counts
    spark = df.sparkSession
    cc = column_counts(df)
    miss = missing_from_counts(df, cc)
    dtypes = spark.createDataFrame([(i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                   "ordinal int, dtype string")
    s1 = miss.join(F.broadcast(dtypes), "ordinal").select(
        F.lit(1).alias("section"), "ordinal",
        F.format_string("%d %s %d non-null %s", "ordinal", "column", "non_null", "dtype").alias("line"))
    mo = miss.filter("missing > 0")
    none = spark.range(1).select(F.lit(2).alias("section"), F.lit(0).alias("ordinal"),
                                 F.lit("No missing values.").alias("line"))
    s2 = mo.select(F.lit(2).alias("section"), "ordinal", F.format_string("%s %d", "column", "missing").alias("line"))
    s2 = s2.unionByName(none.join(F.broadcast(mo.agg(F.count(F.lit(1)).alias("k"))), how="cross")
                            .filter("k = 0").drop("k"))
    d = describe_shared(df, cc)
    pos = {c: i for i, c in enumerate(df.columns)}
    of = lambda cols: F.col("ordinal").isin([pos[c] for c in cols])
    num = d.filter(of(numeric_columns(df))).select(
        F.lit(3).alias("section"), "ordinal",
        F.format_string("%s count=%d mean=%s std=%s min=%s p25=%s p50=%s p75=%s max=%s", "column", "count",
                        *[_num(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]).alias("line"))
    cat = d.filter(of(categorical_columns(df))).select(
        F.lit(3).alias("section"), "ordinal",
        F.format_string("%s count=%d unique=%d top=%s freq=%s", "column", "count", "unique",
                        F.coalesce("top", F.lit("NaN")), F.coalesce(F.col("freq").cast("string"), F.lit("NaN"))).alias("line"))
    dtm = d.filter(of(datetime_columns(df))).select(
        F.lit(3).alias("section"), "ordinal",
        F.format_string("%s count=%d mean=%s min=%s p25=%s p50=%s p75=%s max=%s", "column", "count",
                        *[F.coalesce(F.col(f"{c}_ts"), F.lit("NaT"))
                          for c in ("mean", "min", "p25", "p50", "p75", "max")]).alias("line"))
    head = sample_head(df, 5, order_by)
    from pyspark.sql import Window
    # ordinal of the (at most 5) head rows: a window over the limited result only
    s4 = head.select(F.lit(4).alias("section"),
                     (F.row_number().over(Window.orderBy(*[col(k) for k in (order_by or df.columns[:1])])) - 1).alias("ordinal"),
                     F.concat_ws(" | ", *[F.coalesce(_cell(c, df.schema[c].dataType), F.lit("NaN")) for c in df.columns]).alias("line"))
    return s1.unionByName(s2).unionByName(num).unionByName(cat).unionByName(dtm).unionByName(s4)


def profile_text_lines(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Sections with their headings, as ``(section, ordinal, line)`` where
    heading lines have ordinal -1; writing them sorted gives the text."""
    heads = df.sparkSession.createDataFrame(
        [(i + 1, -1, f"--- {s} ---") for i, s in enumerate(SECTIONS)], "section int, ordinal int, line string")
    return heads.unionByName(profile_sections(df, order_by))


def _esc(c) -> F.Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def report_html(df: DataFrame, title: str = "Dataset Profiling Report") -> DataFrame:
    """``(ordinal, line)``: an HTML page with the overview, the variables
    table and the alerts. Row order by ``ordinal``."""
    spark = df.sparkSession
    ov = report_overview(df)
    cells = [F.concat(F.lit("<tr><th>"), F.lit(c), F.lit("</th><td>"), _esc(F.col(c)), F.lit("</td></tr>"))
             for c in ov.columns]
    ov_lines = ov.select(F.posexplode(F.array(*cells)).alias("pos", "line")).select(
        (F.col("pos") + 100).alias("ordinal"), "line")
    var = report_variables(df).select(
        (F.col("ordinal") + 10_000).alias("ordinal"),
        F.concat(F.lit("<tr><td>"), _esc(F.col("column")), F.lit("</td><td>"), _esc(F.col("distinct")),
                 F.lit("</td><td>"), _esc(F.round("distinct_pct", 2)), F.lit("</td><td>"), _esc(F.col("missing")),
                 F.lit("</td><td>"), _esc(F.round("missing_pct", 2)), F.lit("</td></tr>")).alias("line"))
    al = report_alerts(df).select(
        F.lit(1_000_000).alias("ordinal"),
        F.concat(F.lit("<li>"), _esc(F.col("alert")), F.lit(": "), _esc(F.col("column")), F.lit(" ("),
                 _esc(F.round("value", 2)), F.lit(")</li>")).alias("line"))
    fixed = [(0, f"<html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1>"),
             (1, "<h2>Overview</h2><table>"), (9_999, "</table><h2>Variables</h2><table>"
              "<tr><th>column</th><th>distinct</th><th>distinct %</th><th>missing</th><th>missing %</th></tr>"),
             (999_999, "</table><h2>Alerts</h2><ul>"), (2_000_000, "</ul></body></html>")]
    return spark.createDataFrame(fixed, "ordinal int, line string").unionByName(ov_lines).unionByName(
        var).unionByName(al)
