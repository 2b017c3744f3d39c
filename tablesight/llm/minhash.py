"""MinHash near-duplicate detection with a multi-index Hamming join.

Signature: SYMBOLS minima, of each the low 8 bits after mixing (b-bit MinHash).
Two sets with Jaccard similarity s differ in a symbol with probability of
about 1 - s, so near copies lie within a small Hamming distance (in symbols).

Join: the signature is split into CHUNKS chunks. By pigeonhole, signatures
within distance CHUNKS * (ERRORS + 1) - 1 agree in some chunk but for ERRORS
symbols at most. Each signature enumerates, for every chunk, all ways to leave
out ERRORS symbols; equal remainders are an index hit. So every pair within
the distance meets in a bucket, and many beyond it do. A pair becomes a link
only after comparing the full shingle sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, local_components
from .kernel import mix, seeds, shingle_sets
from .shared import Scratch, column_bytes

SYMBOLS, CHUNKS, ERRORS = 48, 8, 1
#: A member is not compared with its leader if they are farther apart. At similarity 0.85 the distance is
#: binomial(48, 0.15): beyond 22 in less than 1 of 10 million pairs.
MAX_DISTANCE = 22
SIG = [f"s{i}" for i in range(SYMBOLS // 8)]
#: Bits of the filter of candidate ids, by their number; at most 2^MAX_BITS in all (128 MB).
BITS_PER_ID, MAX_BITS = 16, 30
#: Parts that the rows of a cluster are dealt to where its sizes are looked up.
SALTS = 64
#: Texts per block where components of a bucket are compared with each other.
BLOCK = 768


def signatures(texts: list[bytes]):
    """Per text: set size, two 64-bit sums that identify the set, signature."""
    a, b = seeds(SYMBOLS, 21)[:, None], seeds(SYMBOLS, 22)[:, None]
    for s in shingle_sets(texts):
        low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 2048):
            part = a * s[None, i:i + 2048]
            part += b
            np.minimum(low, part.min(axis=1), out=low)
        symbols = (mix(low) >> np.uint64(56)).astype(np.uint8)
        yield len(s), mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64), symbols.tobytes()


def _sign(batches):
    for batch in batches:
        rows = list(signatures(column_bytes(batch.column(1))))
        sig = np.frombuffer(b"".join(r[3] for r in rows), np.int64).reshape(len(rows), -1)
        sums = np.array([r[1:3] for r in rows], np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]),
             *(pa.array(sig[:, i]) for i in range(len(SIG)))],
            ["doc_id", "n_shingles", "h1", "h2", *SIG])


def _index_keys(batches):
    """(key, node): the remainders of every chunk after leaving out ERRORS symbols."""
    width = SYMBOLS // CHUNKS
    keeps = list(combinations(range(width), width - ERRORS))
    salt = seeds(CHUNKS * len(keeps), 31).reshape(CHUNKS, len(keeps))
    for batch in batches:
        node = batch.column(0).to_numpy()
        sig = np.stack([batch.column(i + 1).to_numpy() for i in range(len(SIG))], axis=1)
        sym = np.ascontiguousarray(sig).view(np.uint8).reshape(len(node), CHUNKS, width).astype(np.uint64)
        for j, keep in enumerate(keeps):
            packed = np.zeros((len(node), CHUNKS), np.uint64)
            for k in keep:
                packed = (packed << np.uint64(8)) | sym[:, :, k]
            keys = mix(packed ^ salt[None, :, j]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(node, CHUNKS))], ["key", "node"])


def distance(left: str, right: str) -> Column:
    """Differing 8-bit symbols of two packed signatures."""
    total = F.lit(0)
    for s in SIG:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _sets(batches):
    """Shingle sets of candidate documents; rows whose text has another set go
    (a repeated doc_id with a different text)."""
    for batch in batches:
        keep, sets = [], []
        h1, h2 = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
        for i, s in enumerate(shingle_sets(column_bytes(batch.column("text")))):
            got = np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64)]).view(np.int64)
            if got[0] == h1[i] and got[1] == h2[i]:
                keep.append(i)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())],
                                         ["node", "shingles"])


def _linked(percent: int):
    def check(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return check


def possible(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is among ``ids`` or shares a filter bit with
    one, so that few texts are shuffled for the join that follows. The filter
    is broadcast: BITS_PER_ID bits an id and 2^MAX_BITS at most; where that is
    less a share of rows, more of them pass, and the join is right anyway."""
    bits = min(MAX_BITS, max(15, (BITS_PER_ID * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << bits))
    place, bucket = slot.bitwiseAND(F.lit(32767)), F.shiftright(slot, 15)
    filters = ids.select(F.col(ids.columns[0]).alias(id_col)).groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = docs.join(F.broadcast(filters), bucket == F.col("_bucket"))
    return met.filter(bit_set(byte, place)).select(*docs.columns)


def bit_set(byte: Column, place: Column) -> Column:
    """Whether the bit of ``place`` is set in its byte of a filter."""
    mask = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), place.bitwiseAND(F.lit(7)).cast("int") + 1)
    return byte.bitwiseAND(mask) > 0


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| holds for their
    sets of 5-word shingles (ASCII lower-cased words). component_id is the
    smallest doc_id that links reach; kept marks that document.

    Null, empty or wordless texts have no shingles and stay alone. A null
    doc_id has no links and is kept, with a null component. Repeated rows get
    equal results. A doc_id of several texts has the links of all of them, and
    all its rows that have words get the component of the id. Other columns are ignored.

    Texts with equal sets form one class. Classes meet in index buckets; each
    bucket compares its members with one leader, so a bucket of n similar
    texts costs n comparisons. Buckets that then still hold several components
    are compared in full, but for pairs inside a component, block by block in
    tasks of bounded size that return spanning links only. Work is quadratic
    only in such clusters of texts that are alike but not linked.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig_type = "doc_id long, n_shingles long, h1 long, h2 long, " + ", ".join(f"{s} long" for s in SIG)
    signed = scratch.put(docs.mapInArrow(_sign, sig_type))
    identity = ["n_shingles", "h1", "h2"]
    linkable = signed.filter("n_shingles > 0 and doc_id is not null")
    # A class is named by its smallest doc_id, or by a hash where some of its
    # ids have other texts too; those classes belong together.
    several = scratch.put(linkable.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("doc_id"))
    mixed = linkable.join(several, "doc_id").select("doc_id", *identity).distinct().withColumn("name", F.xxhash64(*identity))
    mixed = scratch.put(mixed)
    classes = linkable.groupBy(*identity).agg(F.min("doc_id").alias("doc"), *(F.min(s).alias(s) for s in SIG))
    named = mixed.select(*identity, "name").distinct()
    classes = scratch.put(classes.join(named, identity, "left").withColumn("node", F.coalesce("name", "doc")).drop("name"))
    together = mixed.groupBy("doc_id").agg(F.min("name").alias("b")).join(mixed.select("doc_id", F.col("name").alias("a")), "doc_id")
    together = scratch.put(together.filter("a <> b").select("a", "b").distinct())

    keyed = classes.select("node", *SIG).mapInArrow(_index_keys, "key long, node long")
    keyed = scratch.put(keyed)
    # Written, so that both sides of the joins are plain shuffles and adaptive
    # execution can split the partition of a hot bucket.
    lead = scratch.put(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).filter("n > 1").select("key", "lead"))
    bucketed = scratch.put(keyed.join(lead, "key"))
    scratch.drop(keyed)
    sig = F.struct(*SIG)
    need = bucketed.select("node").distinct()
    candidates = scratch.put(classes.join(need, "node").select("node", "doc", "h1", "h2", *SIG))
    texts = possible(docs, candidates.select("doc"), "doc_id").join(candidates.select(F.col("doc").alias("doc_id"), "node", "h1", "h2"), "doc_id")
    sets = scratch.put(texts.select("node", "h1", "h2", "text").mapInArrow(_sets, "node long, shingles binary")
                       .dropDuplicates(["node"]))
    near = candidates.select("node", sig.alias("sig"))

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        sa = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        sb = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(_linked(percent), "a long, b long")

    def with_signatures(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(near.toDF("a", "x"), "a").join(near.toDF("b", "y"), "b")
        return pairs.filter(distance("x", "y") <= MAX_DISTANCE).select("a", "b")

    pairs = bucketed.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    found = scratch.put(links(with_signatures(pairs)))
    part = _parts(candidates, found, scratch)
    found = found.union(scratch.put(_cross_links(bucketed, part, sets, percent, scratch)))
    comps = components(found.union(together), scratch)
    grouped = classes.select(*identity, "node", "doc").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # The smallest doc_id of each component of several classes.
    least = scratch.put(grouped.select("component", "doc", *identity))
    smallest = least.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("k")).filter("k > 1").drop("k")
    members = least.join(smallest, "component", "left").select(*identity, F.coalesce("component_id", "doc").alias("component_id"))
    return (signed.join(members, identity, "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _parts(candidates: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of each candidate."""
    comps = components(found, scratch)
    return scratch.put(candidates.select("node").join(comps, "node", "left")
                       .select("node", F.coalesce("component", "node").alias("component")))


def _cross_links(bucketed: DataFrame, part: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different components that share a bucket.

    Buckets that still hold several components are gathered into clusters, by
    their members. In a cluster, everything outside its largest component is
    compared with everything, in blocks of BLOCK texts; each pair of blocks is
    a task of bounded size that returns spanning links, not pairs."""
    entries = bucketed.join(part, "node")
    split = entries.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    star = bucketed.join(scratch.put(split.select("key")), "key").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    cluster = components(star, scratch).select("node", F.col("component").alias("cluster"))
    nodes = scratch.put(cluster.join(part, "node"))
    sizes = nodes.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    most = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).select(
        "cluster", F.col("most.component").alias("largest"), F.ceil(F.col("most.n") / BLOCK).alias("large"),
        F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("small"))
    # Blocks 0 .. small - 1 hold the rest, small .. small + large - 1 the largest component.
    inside = F.col("component") == F.col("largest")
    # Salted, as a cluster may hold a large share of all rows.
    most = most.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    placed = nodes.join(most, ["cluster", "salt"]).withColumn(
        "block", F.when(inside, F.col("small") + F.pmod(F.xxhash64("node"), F.col("large"))).otherwise(F.pmod(F.xxhash64("node"), F.col("small"))))
    upto = F.when(inside, F.col("small")).otherwise(F.col("small") + F.col("large"))
    placed = placed.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), upto - 1)))
    placed = placed.select("cluster", "node", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "shingles")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node, component, block = (pdf[c].to_numpy() for c in ("node", "component", "block"))
        own = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        size = np.array([len(x) for x in own])
        both = common(own)
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        linked &= component[:, None] != component[None, :]
        if pdf["low"].iat[0] != pdf["high"].iat[0]:
            linked &= block[:, None] != block[None, :]
        root = node[local_components(linked)]
        return pd.DataFrame({"a": node, "b": root})[node != root]

    return placed.groupBy("cluster", "low", "high").applyInPandas(compare, "a long, b long")


def common(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, from products of membership matrices of
    ``width`` shingles at a time; shingles of one set only are left out."""
    every = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, at, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    of, at = of[keep], shared[at[keep]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for a in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
        lo, hi = np.searchsorted(at, [a, a + width])
        member = np.zeros((len(sets), width), np.float32)
        member[of[lo:hi], at[lo:hi] - a] = 1
        total += member @ member.T
    return total
