"""Quality rules with thresholds that adapt to language and source.

Measures of each text are reduced to quantile sketches per (lang, source):
logarithmic buckets with counts, of relative error SKETCH_ERROR. Such sketches
merge by adding counts, exactly and in any order, so the result doesn't depend
on partitioning, and a small group can borrow the merged sketch of its
language, or of everything. Fences derived from the quartiles and, for
measures that are mostly zero, an upper quantile replace fixed cutoffs; they join back to the documents and filter them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import SHINGLE_WORDS, Words, blocks
from .shared import Scratch, column_bytes

SYMBOL_BYTES = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SKETCH_ERROR = 0.01
#: Groups with fewer texts use the merged sketch of their language, then of all.
MIN_GROUP = 200
#: Outer fences: quartile -/+ FENCE times the distance between the quartiles.
FENCE = 3.0
#: These measures are zero for most texts, and so are their quartiles. Their
#: fence is at least the UPPER quantile of the group, but if that is farther from
#: the median than this: there, more than a few texts of the group are junk.
UPPER = 0.99
FARTHEST = {"symbols_per_word": 0.1, "dup_line_share": 0.3, "repeat_word_share": 0.2}
#: measure -> (numerator, denominator, has a lower fence, tolerance): a fence is
#: never nearer to the median than the tolerance, a few errors of the sketch,
#: so that a group in which a measure hardly varies doesn't lose ordinary texts.
MEASURES = {
    "mean_word_chars": ("word_chars", "n_words", True, 0.5),
    "symbols_per_word": ("n_symbols", "n_words", False, 0.01),
    "dup_line_share": ("n_dup_lines", "n_lines", False, 0.03),
    "repeat_word_share": ("n_repeat_words", "n_words", False, 0.02),
}


def text_counts(texts: list[bytes]) -> np.ndarray:
    """Row per text: the columns of COUNTS."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOL_BYTES)] = True
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for a, b in blocks(texts):
        w = Words(texts[a:b], lower=False)
        at = np.minimum(w.text_at, len(w.buf))

        def per_text(flags):
            return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])

        in_word = np.zeros(len(w.buf) + 1, np.int8)
        in_word[w.starts] += 1
        in_word[w.ends] -= 1
        in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
        out[a:b, 0] = np.diff(w.first)
        out[a:b, 1] = per_text(in_word & ((w.buf & 0xC0) != 0x80))
        out[a:b, 2] = per_text(symbol[w.buf])
        windows = w.windows()
        for i in range(a, b):
            lines = [x for x in texts[i].split(b"\n") if x.strip()]
            out[i, 3:5] = len(lines), len(lines) - len(set(lines))
            lo, hi = w.first[i - a], w.first[i - a + 1]
            n = hi - lo - SHINGLE_WORDS + 1
            if n > 1:
                _, inverse, count = np.unique(windows[lo:lo + n], return_inverse=True, return_counts=True)
                again = np.flatnonzero(count[inverse] > 1)
                if len(again):
                    cover = np.zeros(hi - lo + 1, np.int64)
                    np.add.at(cover, again, 1)
                    np.add.at(cover, again + SHINGLE_WORDS, -1)
                    out[i, 5] = np.count_nonzero(np.cumsum(cover))
    return out


def _measure(batches):
    for batch in batches:
        counts = text_counts(column_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(counts[:, i]) for i in range(len(COUNTS)))],
            ["doc_id", "lang", "source", *COUNTS])


def sketch(df: DataFrame, groups: list[str], value: str = "value") -> DataFrame:
    """Mergeable quantile sketch of a non-negative column: (groups, bucket, n).

    Bucket b holds values of (g ** (b - 1), g ** b], g = (1 + e) / (1 - e);
    zero has a bucket of its own, null none. Merge by adding n per bucket."""
    g = math.log((1 + SKETCH_ERROR) / (1 - SKETCH_ERROR))
    bucket = F.when(F.col(value) > 0, F.ceil(F.log(value) / g)).otherwise(-1_000_000).cast("long")
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], qs: list[float]) -> DataFrame:
    """(groups, total, q0, q1, ...): the value of the bucket that holds rank
    ceil(q * total). A group has as many rows as buckets, a bounded number."""
    g = (1 + SKETCH_ERROR) / (1 - SKETCH_ERROR)
    merged = sketches.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*groups)
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    value = F.when(F.col("bucket") == -1_000_000, 0.0).otherwise(F.pow(F.lit(g), F.col("bucket")) * (2 / (g + 1)))
    return ranked.groupBy(*groups).agg(
        F.max("total").alias("total"),
        *(F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), value)).alias(f"q{i}") for i, q in enumerate(qs)))


def fences(measured: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, <measure>_lo, <measure>_hi ...) for each pair that occurs."""
    long = measured.select("lang", "source", F.inline(F.array(*(
        F.struct(F.lit(m).alias("measure"), (F.col(a) / F.when(F.col(b) > 0, F.col(b))).alias("value"))
        for m, (a, b, _, _) in MEASURES.items()))))
    base = scratch.put(sketch(long, ["lang", "source", "measure"]))
    ranks = [0.25, 0.5, 0.75, UPPER]
    wide = ["total", "q0", "q1", "q2", "q3"]
    out = base.select("lang", "source", "measure").distinct()
    for level, keys in (("of_pair", ["lang", "source"]), ("of_lang", ["lang"]), ("of_all", [])):
        q = quantiles(base, [*keys, "measure"], ranks).select(
            *(F.col(k).alias(f"{k}_") for k in [*keys, "measure"]), F.struct(*wide).alias(level))
        on = F.col("measure") == F.col("measure_")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
        out = out.join(q, on, "left").drop(*(f"{k}_" for k in [*keys, "measure"]))
    out = out.withColumn("q", F.when(F.col("of_pair.total") >= MIN_GROUP, F.col("of_pair"))
                         .when(F.col("of_lang.total") >= MIN_GROUP, F.col("of_lang")).otherwise(F.col("of_all")))
    spread = FENCE * (F.col("q.q2") - F.col("q.q0"))
    tolerance = F.element_at(F.create_map(*(F.lit(x) for m, (*_, t) in MEASURES.items() for x in (m, t))), F.col("measure"))
    farthest = F.element_at(F.create_map(*(F.lit(x) for m, t in FARTHEST.items() for x in (m, t))), F.col("measure"))
    # The upper end of the quantile's bucket; null, so without effect, for other measures.
    upper = F.when(farthest.isNotNull(), F.least(F.col("q.q3") / (1 - SKETCH_ERROR) * (1 + 1e-9), F.col("q.q1") + farthest))
    out = out.select("lang", "source", "measure",
                     F.least(F.col("q.q0") - spread, F.col("q.q1") - tolerance).alias("lo"),
                     F.greatest(F.col("q.q2") + spread, F.col("q.q1") + tolerance, upper).alias("hi"))
    return out.groupBy("lang", "source").agg(*(
        F.max(F.when(F.col("measure") == m, F.col(end))).alias(f"{m}_{end}") for m in MEASURES for end in ("lo", "hi")))


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): the counts of
    COUNTS, base_failed, kept and the names of the failed measures.

    A null, empty or wordless text has zero words and fails the base rules.
    Null languages and sources form groups of their own. Repeated rows are
    judged alike; extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    measured = scratch.put(docs.mapInArrow(_measure, schema))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # Texts that fail the base rules are junk; they don't set thresholds.
    limits = fences(measured.filter(~base_failed), scratch).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    failed = []
    for m, (a, b, lower, _) in MEASURES.items():
        value = F.col(a) / F.when(F.col(b) > 0, F.col(b))
        bad = value > F.col(f"{m}_hi")
        failed.append(F.when((bad | (value < F.col(f"{m}_lo"))) if lower else bad, F.lit(m)))
    return (joined.withColumn("base_failed", base_failed)
            .withColumn("failed", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.array_compact(F.array(*failed))))
            .withColumn("kept", F.size("failed") == 0)
            .select("doc_id", *COUNTS, "base_failed", "kept", "failed"))
