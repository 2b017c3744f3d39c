"""Connected components of a link table, as DataFrame jobs, and of a small
link matrix inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b), where component is
    the smallest node that can be reached.

    Alternates large-star and small-star steps until the link table stays the
    same; each step links nodes to the smallest neighbour known, so long
    chains shrink in a logarithmic number of rounds. Both steps are one
    grouped minimum and one join; nothing reaches the driver but a checksum.
    """
    edges = scratch.put(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen or not sums[0]:
            break
        seen = sums
        # Large star: neighbours above u move to the smallest neighbour of u.
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.put(small)
        scratch.drop(edges)
        edges = after
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def local_components(linked: np.ndarray) -> np.ndarray:
    """Smallest index that links reach, per row of a symmetric link matrix."""
    label = np.arange(len(linked))
    a, b = np.nonzero(linked)
    while len(a):
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return label
