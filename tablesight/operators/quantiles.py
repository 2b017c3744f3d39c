"""Quantiles per group with linear interpolation (pandas / SQL
``quantile_cont`` semantics), exact and distributed.

Spark's exact ``percentile`` merges a whole group's value->count map in a
single task, which does not survive a column with billions of distinct
values. ``quantiles`` brackets each wanted rank with a sketch and ranks only
the values inside (two passes, hardly any shuffle). ``quantiles_from_counts``
starts from a table of distinct values with counts, which a sketch of rows
cannot bracket: it cuts large groups into range buckets, finds the buckets
that hold wanted ranks from running totals, and ranks only those.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import estimated_bytes, reuse

#: Groups of at most FEW * accuracy values are ranked whole.
FEW = 4
#: Width of a bracket to each side, in units of the sketch's rank error.
MARGIN = 2
MAX_PER_TASK = 2_000_000
MAX_BUCKETS = 4096
ONE_TASK_BYTES = 256 << 20  # distinct-value tables estimated below this rank in one pass


def _bucket_of(bounds: str, value: str, nb: int) -> F.Column:
    # Binary search: number of bounds strictly below the value (0..nb).
    steps = max(1, nb.bit_length() + 1)
    mid = "cast((s.lo + s.hi) div 2 as int)"
    return F.expr(f"""
      aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {nb}),
        (s, i) -> CASE WHEN s.lo >= s.hi THEN s
                       WHEN element_at({bounds}, {mid} + 1) < {value}
                         THEN named_struct('lo', {mid} + 1, 'hi', s.hi)
                       ELSE named_struct('lo', s.lo, 'hi', {mid}) END).lo""")


def _one_pass(vc: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    # Small inputs: one window per group gives each distinct value's rank
    # range and the group total in the same pass; rows holding a wanted rank
    # are picked with array functions, no join.
    w = Window.partitionBy(*keys).orderBy("v")
    run = (vc.withColumn("v_end", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
             .withColumn("v_start", F.col("v_end") - F.col("n")))
    plist = ", ".join(f"named_struct('pi', {i}, 'p', CAST({p!r} AS DOUBLE))" for i, p in enumerate(probs))
    hits = run.selectExpr(*keys, "v", f"""filter(transform(array({plist}), x -> named_struct(
        'pi', x.pi, 'frac', (total - 1) * x.p - floor((total - 1) * x.p),
        'r1', CAST(floor((total - 1) * x.p) AS BIGINT) + 1, 'r2', CAST(ceil((total - 1) * x.p) AS BIGINT) + 1,
        'v_start', v_start, 'v_end', v_end)),
      h -> (h.r1 > h.v_start AND h.r1 <= h.v_end) OR (h.r2 > h.v_start AND h.r2 <= h.v_end)) AS hits""")
    h = hits.select(*keys, "v", F.explode("hits").alias("h"))
    inside = lambda r: (F.col(f"h.{r}") > F.col("h.v_start")) & (F.col(f"h.{r}") <= F.col("h.v_end"))
    pick = (h.groupBy(*keys, F.col("h.pi").alias("pi"), F.col("h.frac").alias("frac"))
             .agg(F.max(F.when(inside("r1"), F.col("v"))).alias("v1"),
                  F.max(F.when(inside("r2"), F.col("v"))).alias("v2")))
    q = pick.select(*keys, "pi", (F.col("v1") + (F.col("v2") - F.col("v1")) * F.col("frac")).alias("q"))
    return q.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pi", "q"))), lambda s: s["q"]).alias("quantiles"))


def quantiles(long: DataFrame, probs: Sequence[float], keys: Sequence[str] = ("ordinal", "column"),
              value: str = "value", exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """``(keys..., quantiles array<double>)``, one array entry per prob.

    ``long`` holds one row per observation; nulls are skipped. Groups with no
    value are absent (callers left-join).
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    v = long.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    if not exact:
        return v.groupBy(*keys).agg(F.percentile_approx("v", probs, accuracy).alias("quantiles"))
    return _bracketed(v, keys, probs, accuracy)


def _ends(probs: list[float], accuracy: int) -> list[float]:
    """Where brackets begin and end: the sketch's rank error is at most one in
    ``accuracy``; twice that on each side."""
    margin = MARGIN / accuracy
    return [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]


def _bracketed(v: DataFrame, keys: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """Exact quantiles in two passes over the values, the same plan at any size.

    Pass 1: counts and ``percentile_approx`` a little below and above each
    wanted rank. Groups of few values have one open bracket (at most FEW *
    accuracy values).
    Pass 2: a value's slot is the number of brackets that end below it;
    values inside a bracket are grouped by slot and value,
    those between brackets by slot alone. One row a value, and a few per ten
    thousand of the rows reach the shuffle. Running totals of these counts say
    which value holds each rank. They are counts of all values, not estimates:
    a rank that falls between two brackets is seen to do so.
    Pass 3, only for ranks that fell between brackets (the sketch was wrong):
    the values between those two brackets are counted and ranked themselves.
    Adaptive execution drops this pass when no rank is missed.
    """
    by_rank = sorted(range(len(probs)), key=lambda i: probs[i])
    ordered, k = [probs[i] for i in by_rank], len(probs)
    stats = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.percentile_approx("v", _ends(ordered, accuracy), accuracy).alias("ends"))
    many = F.col("total") > FEW * accuracy
    # NaN is above every number; there are no NaN among the values.
    ends = stats.select(*keys, F.when(many, F.slice("ends", 1, k)).otherwise(F.array_repeat(F.lit(float("-inf")), k)).alias("lo"),
                        F.when(many, F.slice("ends", k + 1, k)).otherwise(F.array_repeat(F.lit(float("nan")), k)).alias("hi"))
    # Few brackets: comparisons that are compiled; many: a binary search.
    slot = F.expr(" + ".join(f"IF(hi[{i}] < v, 1, 0)" for i in range(k))) if k <= 16 else _bucket_of("hi", "v", k)
    cells = (v.join(F.broadcast(ends), keys).withColumn("slot", slot)
             .select(*keys, "slot", F.when(F.col("v") >= F.get("lo", F.col("slot")), F.col("v")).alias("cell")))
    counts = cells.groupBy(*keys, "slot", "cell").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("slot", F.col("cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("v_end", F.sum("n").over(w)).withColumn("v_start", F.col("v_end") - F.col("n"))

    # The two ranks around each wanted place; one row per group, probability and rank.
    h = (F.col("total") - 1) * F.col("p")
    places = stats.select(*keys, "total", F.posexplode(F.array(*[F.lit(probs[i]) for i in range(k)])).alias("pi", "p"))
    ranks = F.array(*(F.struct(F.lit(i).alias("side"), (r + 1).cast("long").alias("rank")) for i, r in enumerate((F.floor(h), F.ceil(h)))))
    places = places.select(*keys, "pi", (h - F.floor(h)).alias("frac"), F.explode(ranks).alias("at")).select(*keys, "pi", "frac", "at.side", "at.rank")
    found = ranked.join(F.broadcast(places), keys).filter((F.col("rank") > F.col("v_start")) & (F.col("rank") <= F.col("v_end")))
    found = found.select(*keys, "pi", "frac", "side", "rank", "slot", "v_start", F.col("cell").alias("value"))

    missed = found.filter(F.col("value").isNull())
    gaps = missed.select(*keys, "slot", "v_start").distinct().join(ends, keys).select(
        *keys, "slot", "v_start", F.get("hi", F.col("slot") - 1).alias("above"), F.get("lo", F.col("slot")).alias("below"))
    between = (F.col("above").isNull() | (F.col("v") > F.col("above"))) & (F.col("below").isNull() | (F.col("v") < F.col("below")))
    inside = v.join(F.broadcast(gaps), keys).filter(between).groupBy(*keys, "slot", "v_start", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("to", F.col("v_start") + F.sum("n").over(w)).withColumn("from", F.col("to") - F.col("n"))
    again = missed.drop("value", "v_start").join(inside.select(*keys, "slot", F.col("v").alias("value"), "from", "to"), [*keys, "slot"])
    again = again.filter((F.col("rank") > F.col("from")) & (F.col("rank") <= F.col("to")))

    columns = [*keys, "pi", "frac", "side", "value"]
    both = found.filter(F.col("value").isNotNull()).select(columns).union(again.select(columns))
    picked = both.groupBy(*keys, "pi", "frac").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("v1"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("v2"))
    # Equal neighbours are taken as they are: infinity minus infinity is no number.
    value = F.when(F.col("v1") == F.col("v2"), F.col("v1")).otherwise(F.col("v1") + (F.col("v2") - F.col("v1")) * F.col("frac"))
    return picked.select(*keys, "pi", value.alias("q")).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pi", "q"))), lambda s: s["q"]).alias("quantiles"))


def quantiles_from_counts(vc: DataFrame, probs: Sequence[float], keys: Sequence[str] = ("ordinal",),
                          max_per_task: int = MAX_PER_TASK, accuracy: int = 10000,
                          one_task_bytes: int = ONE_TASK_BYTES) -> DataFrame:
    """Exact quantiles from distinct values ``v`` (non-null double) with
    counts ``n`` per group; same output as ``quantiles``."""
    keys = list(keys)
    probs = [float(p) for p in probs]
    if estimated_bytes(vc) <= one_task_bytes:
        return _one_pass(vc, keys, probs)
    vc = reuse(vc, "quantile-values")
    meta = vc.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    widest = meta.agg(F.max("distinct")).first()[0] or 0
    nb = min(MAX_BUCKETS, max(1, math.ceil(widest / max_per_task)))

    # ranks (1-based) around h = (total - 1) * p, per group and prob (small)
    pa = F.array(*[F.lit(p) for p in probs])
    tg = (meta.select(*keys, "total", F.posexplode(pa).alias("pi", "p"))
              .withColumn("h", (F.col("total") - 1) * F.col("p"))
              .select(*keys, "pi", (F.col("h") - F.floor("h")).alias("frac"),
                      (F.floor("h").cast("long") + 1).alias("r1"), (F.ceil("h").cast("long") + 1).alias("r2")))

    if nb > 1:
        cuts = [i / nb for i in range(1, nb)]
        bounds = vc.groupBy(*keys).agg(F.percentile_approx("v", cuts, max(accuracy, 4 * nb)).alias("bounds"))
        vb = (vc.join(F.broadcast(bounds), keys)
                .select(*keys, "v", "n", _bucket_of("bounds", "v", len(cuts)).alias("bucket")))
        # running offsets of the buckets (at most nb rows per group)
        tot = vb.groupBy(*keys, "bucket").agg(F.sum("n").alias("bn"))
        wk = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        tot = tot.withColumn("b_start", F.sum("bn").over(wk) - F.col("bn"))
        ranks = tg.select(*keys, F.explode(F.array("r1", "r2")).alias("r"))
        want = (ranks.join(F.broadcast(tot), keys)
                     .filter((F.col("r") > F.col("b_start")) & (F.col("r") <= F.col("b_start") + F.col("bn")))
                     .select(*keys, "bucket", "b_start").distinct())
        sel = vb.join(F.broadcast(want), keys + ["bucket"])
        part = keys + ["bucket"]
    else:
        sel = vc.withColumn("b_start", F.lit(0).cast("long"))
        part = keys
    wv = Window.partitionBy(*part).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    sel = (sel.withColumn("v_end", F.col("b_start") + F.sum("n").over(wv))
              .select(*keys, "v", "v_end", (F.col("v_end") - F.col("n")).alias("v_start")))

    inside = lambda r: (F.col(r) > F.col("v_start")) & (F.col(r) <= F.col("v_end"))
    hits = (sel.join(F.broadcast(tg), keys).filter(inside("r1") | inside("r2"))
               .groupBy(*keys, "pi", "frac")
               .agg(F.max(F.when(inside("r1"), F.col("v"))).alias("v1"),
                    F.max(F.when(inside("r2"), F.col("v"))).alias("v2")))
    q = hits.select(*keys, "pi", (F.col("v1") + (F.col("v2") - F.col("v1")) * F.col("frac")).alias("q"))
    return q.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pi", "q"))), lambda s: s["q"]).alias("quantiles"))
