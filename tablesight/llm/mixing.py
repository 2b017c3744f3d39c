"""Mixing sources to target weights.

Sizes are summed per source, targets and repetition rates follow from the
sums, and each document is emitted floor(rate) times plus once more with
probability frac(rate), decided by a seeded hash of its id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_PATTERN

WEIGHTS = (3, 1, 2)
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Sources in order of code points, null last, get the weights in turn and
    share ``share`` of all sizes by weight. No target exceeds ``most`` times
    its source's size; what is left over goes to the others by weight, again
    and again, until none is above. That ends at a common level L with target
    = min(weight * L, cap): order sources by cap / weight, and L is reached at
    the first source whose cap holds after all before it are full. One row per
    source; the window sees one row per source, never documents.
    """
    place = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    n = len(weights)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (((F.row_number().over(place) - 1) % n) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    t = (t.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(share) - F.col("full")) / F.col("open"))
         .withColumn("own", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))))
    # The first source in level order that stays below its cap sets the level.
    first = F.first("own", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (t.withColumn("level", first)
            .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("level"), F.col("cap"))))
            .select("source", "source_size", "weight", "target"))


def draw(*key: Column | str, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from a seeded hash: 52 bits of an MD5 sum."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("")) for k in key))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, more) with size, source_size, target,
    copies and taken (size * copies); a row per document, copies may be 0.

    size counts the words of the text (null: 0). A null source is a source of
    its own and comes last. A source of size zero has rate 0. The extra copy is
    drawn by doc_id, for a null doc_id by the text instead, so that a source
    of null ids comes near its target too. Repeated rows take the same decision. Extra columns stay, but for those whose names the
    results carry, which are replaced.

    The sums per source are combined in each task before the shuffle, so a hot
    source is no hot task. The table of targets has one row per source and
    joins back; Spark broadcasts it when it is small and else splits the
    skewed side of the join.
    """
    made = ["size", "source_size", "target", "weight", "copies", "taken"]
    # Drawn before the join, so that the join carries no text that the caller doesn't ask for.
    by_text = draw("doc_id", F.md5(F.coalesce("text", F.lit(""))), seed=seed)
    chance = f"draw_{uuid.uuid4().hex}"
    sized = (docs.drop(*made).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long"))
             .withColumn(chance, F.when(F.col("doc_id").isNotNull(), draw("doc_id", seed=seed)).otherwise(by_text)))
    # Own grouping over two columns: the scan reads source and text only.
    sums = (docs.select("source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
            .groupBy("source").agg(F.sum("size").alias("source_size")))
    t = targets(sums, WEIGHTS).select(F.col("source").alias("source_"), "source_size", "target")
    out = sized.join(t, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col(chance) < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).drop(chance).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` says, with the
    columns of ``docs`` as they are, whatever their names."""
    m = mix(docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), seed)
    copies = m.filter("copies > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
