"""Embedding near-duplicates with a random-projection tree forest.

Each of TREES trees splits the vectors recursively along random directions at
the median of a bounded sample; leaves that hold too many rows of the table are
split again on a sample of their own, until they are small or what they hold
lies too close together to part. Vectors within SPILL of a threshold go to both
sides, so that near pairs seldom part. Vectors that share a leaf of any tree
are compared exactly; links found are joined into components.

A pair at cosine 0.95 is 0.316 apart; its projections on a random direction of
d dimensions differ by about 0.316 / sqrt(d). SPILL is half of that, in the
same unit, so one split parts a pair across the threshold with a probability
of a few percent, and the trees miss it only if all of them part it.

Disk: the whole forest is known before vectors are compared, so an exchange
carries a vector once for each node of a few ten thousand rows that it reaches;
the levels below, where most copies arise, are descended in the task. The nodes
are dealt out in passes of bounded bytes, and each pass's shuffle files go
before the next.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .kernel import mix
from .shared import Scratch, tidy_shuffles

TREES = 6
#: The upper levels are fitted on about so many vectors, drawn by a hash, and
#: so many bytes of them.
SAMPLE = 16_384
SAMPLE_BYTES = 64 << 20
#: A tree is split while a leaf holds more than 2 * LEAF rows of the table, on
#: the first sample only where MIN_LEAF of its rows go to either side.
LEAF = 512
MIN_LEAF = 32
SPLIT = 2_048
#: Leaves that then have more than SPLIT rows are split by SPLIT_DEPTH levels
#: in a round, fitted on about SPLIT_SAMPLE of their rows.
SPLIT_SAMPLE = 512
SPLIT_DEPTH = 4
#: A node takes the best of TRIES directions of its tree's POOL, by the pairs
#: left to compare, and isn't split where over WORTH of them are left.
TRIES = 2
POOL = 48
WORTH = 0.8
#: A task descends from a node of at most two blocks of so many rows and bytes;
#: larger leaves are compared block by block.
BLOCK = 16_384
BLOCK_BYTES = 6 << 20
#: A pass deals out so many times the bytes of the vectors, or so many bytes.
PASS_COPIES = 2
PASS_BYTES = 128 << 20
SPILL = 0.158
SEED = 7
#: Components and directions are whole numbers of 1 / UNIT, so that projections
#: are exact sums: a vector takes the same way in every batch and pass.
UNIT = 2.0 ** 25
ROWS = 4_096


def directions(size: int, tree: int, levels: int = POOL) -> np.ndarray:
    """The pool of directions of a tree over vectors of ``size`` components, as
    far as its first levels need it."""
    d = np.random.default_rng([SEED, size, tree]).standard_normal((size, POOL))
    return np.ascontiguousarray(np.rint(d / np.linalg.norm(d, axis=0) * UNIT)[:, :max(1, levels * TRIES)])


def spill(size: int) -> float:
    return SPILL / np.sqrt(max(1, size)) * UNIT * UNIT


def fit(shadow: np.ndarray, rows: float, own: float, limit: int, least: int, depth: int) -> tuple[list, list, list]:
    """A tree of at most ``depth`` levels over a sample of a node of ``rows``
    rows, by breadth: (column, threshold, rows) of each node. Columns are those
    of ``shadow``, TRIES for each level; for leaves -1, or -2 if their rows are
    to be split on."""
    column, threshold, size, queue = [], [], [], [(np.arange(len(shadow)), 0)]
    while queue:
        following = []
        for members, level in queue:
            column.append(-1)
            threshold.append(0.0)
            size.append(rows * len(members) / max(1, len(shadow)))
            if size[-1] <= limit:
                continue
            if level == depth or len(members) < least:
                column[-1] = -2 if size[-1] > SPLIT else -1
                continue
            start = level * TRIES % shadow.shape[1]
            some = shadow[members, start:start + TRIES]
            at = np.median(some, axis=0)
            left, right = some <= at + own, some > at - own
            pairs = left.sum(axis=0, dtype=float) ** 2 + right.sum(axis=0, dtype=float) ** 2
            best = int(pairs.argmin())
            if pairs[best] > WORTH * len(members) ** 2:
                continue
            column[-1], threshold[-1] = start + best, float(at[best])
            following += [(members[left[:, best]], level + 1), (members[right[:, best]], level + 1)]
        queue = following
    return column, threshold, size


class Forest:
    """Trees of all lengths of vectors, as arrays by node: the tree, the level,
    the column of its direction in the pool, the threshold, the left child (the
    right one follows it; -1 for leaves), the parent, about how many rows of
    the table it holds, and whether these are to be split on."""

    KINDS = {"tree": "i2", "level": "i2", "column": "i2", "threshold": "f8", "left": "i4", "parent": "i4", "rows": "f4", "open": "?", "size": "i4"}

    def __init__(self):
        self.nodes = {k: np.zeros(0, kind) for k, kind in self.KINDS.items()}
        self.roots: dict[int, list[int]] = {}

    def plain(self, **more) -> dict:
        """What tasks need, as executors need not have this module."""
        return {k: self.nodes[k] for k in ("tree", "level", "column", "threshold", "left", "size")} | {"roots": self.roots} | more

    def add_roots(self, size: int, trees: int, rows: int, limit: int) -> None:
        n = len(self.nodes["tree"])
        self.roots[size] = [*range(n, n + trees)]
        new = {"tree": np.arange(trees), "level": np.zeros(trees), "column": np.zeros(trees), "threshold": np.zeros(trees), "left": np.full(trees, -1),
               "parent": np.full(trees, -1), "rows": np.full(trees, float(rows)), "open": np.full(trees, rows > limit), "size": np.full(trees, size)}
        self.nodes = {k: np.concatenate([v, new[k].astype(v.dtype)]) for k, v in self.nodes.items()}

    def graft(self, grown: list[tuple]) -> None:
        """Put trees (leaf, columns, thresholds, rows) as ``fit`` returns them in the place of leaves."""
        nodes, parts, n = self.nodes, [], len(self.nodes["tree"])
        for leaf, column, threshold, rows in grown:
            column, rows = np.asarray(column, "i2"), np.asarray(rows, "f8")
            inner = np.flatnonzero(column >= 0)
            # Children stand by breadth, two for each node that has any.
            id_ = np.concatenate([[leaf], n + np.arange(len(column) - 1)])
            left, parent, level = np.full(len(column), -1, "i8"), np.full(len(column), -1, "i8"), np.zeros(len(column), "i4")
            left[inner] = id_[1:][2 * np.arange(len(inner))]
            parent[1:] = np.repeat(id_[inner], 2)
            level[0] = nodes["level"][leaf]
            for k, i in enumerate(inner):
                level[2 * k + 1:2 * k + 3] = level[i] + 1
            n += len(column) - 1
            own = {"tree": np.full(len(column), nodes["tree"][leaf]), "size": np.full(len(column), nodes["size"][leaf]), "level": level,
                   "column": np.maximum(column, 0), "threshold": np.asarray(threshold, "f8"), "left": left, "parent": parent, "rows": rows, "open": column == -2}
            for k in ("column", "threshold", "left", "rows", "open"):
                nodes[k][leaf] = own[k][0]
            parts.append(own)
        self.nodes = {k: np.concatenate([v, *(p[k][1:].astype(v.dtype) for p in parts)]) for k, v in nodes.items()}

    def by_tree(self) -> None:
        """Number the nodes tree by tree, so that leaves of earlier trees have smaller numbers."""
        order = np.argsort(self.nodes["tree"], kind="stable")
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        self.nodes = {k: v[order] for k, v in self.nodes.items()}
        for k in ("left", "parent"):
            self.nodes[k] = np.where(self.nodes[k] >= 0, place[self.nodes[k]], -1).astype(self.KINDS[k])
        self.roots = {size: [int(place[r]) for r in roots] for size, roots in self.roots.items()}

    def above(self, some: np.ndarray) -> np.ndarray:
        """Mask of the given nodes and all nodes above them."""
        out = np.zeros(len(self.nodes["tree"]), bool)
        while len(some):
            out[some] = True
            some = np.unique(self.nodes["parent"][some])
            some = some[some >= 0]
        return out


def descend(forest: dict, shadow: np.ndarray, start: int, own: float, stop: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of the nodes at which the rows of ``shadow`` stop below the
    node ``start``, several for those that spill; only by way of live nodes."""
    column, threshold, left = forest["column"], forest["threshold"], forest["left"]
    rows, nodes, ended = np.arange(len(shadow)), np.full(len(shadow), start, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(rows):
        if live is not None:
            going = live[nodes]
            rows, nodes = rows[going], nodes[going]
        end = stop[nodes]
        if end.any():
            ended.append((rows[end], nodes[end]))
            rows, nodes = rows[~end], nodes[~end]
        offset = shadow[rows, column[nodes]] - threshold[nodes]
        a, b, child = offset <= own, offset > -own, left[nodes]
        rows, nodes = np.concatenate([rows[a], rows[b]]), np.concatenate([child[a], child[b] + 1])
    return np.concatenate([e[0] for e in ended]), np.concatenate([e[1] for e in ended])


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Usable vectors at length 1 in double precision."""
    single, x = x.dtype.itemsize == 4, x.astype(np.float64)
    if not single:
        # Else squares may overflow.
        x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def whole(x: np.ndarray) -> np.ndarray:
    """Unit vectors in whole numbers of 1 / UNIT, in their place."""
    x *= UNIT
    return np.rint(x, out=x)


def usable_rows(x: np.ndarray) -> np.ndarray:
    """Row numbers of usable vectors. Unusable: empty, with null (here NaN) or
    non-finite components, zero, or longer than a double can say."""
    if not x.size:
        return np.zeros(0, np.int64)
    single, x = x.dtype.itemsize == 4, x.astype(np.float64)
    with np.errstate(all="ignore"):
        if single:
            square = np.einsum("ij,ij->i", x, x)
            return np.flatnonzero(np.isfinite(square) & (square > 0))
        most = np.abs(x).max(axis=1)
        long = np.linalg.norm(x / np.where(most > 0, most, 1)[:, None], axis=1) * most
    return np.flatnonzero(np.isfinite(x).all(axis=1) & (long > 0) & np.isfinite(long))


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length from a column of their bytes."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(len(column), -1).view(kind)


def stacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([matrix(c, kind) for c in column.chunks if len(c)])


def binary(rows: np.ndarray) -> pa.Array:
    """A column of the bytes of each row."""
    rows = np.ascontiguousarray(rows)
    at = np.arange(len(rows) + 1, dtype=np.int64) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)]).cast(pa.binary())


def same_length(batch: pa.RecordBatch, kind: str):
    """(part, components of a vector, unit vectors) of parts of a batch whose vectors in ``raw`` have one length."""
    sizes = np.asarray(pc.binary_length(batch.column("raw")))
    for size in np.unique(sizes):
        part = batch if (sizes == size).all() else batch.take(pa.array(np.flatnonzero(sizes == size)))
        step = max(1, min(ROWS, (4 << 20) // size))
        for i in range(0, part.num_rows, step):
            some = part.slice(i, step)
            yield some, int(size) // np.dtype(kind).itemsize, unit_rows(matrix(some.column("raw"), kind))


def margin(size: int) -> float:
    """By how much a product of unit vectors in single precision can be wrong, at most."""
    return (size + 8) * 2.0 ** -23


def tiles(known: np.ndarray, split: int | None):
    """Places (i, j) of the squares of a matrix that hold each pair of rows
    once, or each pair across ``split``, but those among ``known`` rows only."""
    n, some = len(known), known.any()
    for i in range(0, n if split is None else split, 256):
        a = slice(i, min(i + 256, n if split is None else split))
        for j in range(i if split is None else split, n, 2_048):
            b = slice(j, min(j + 2_048, n))
            if not (some and known[a].all() and known[b].all()):
                yield a, b


def share(rows_a: np.ndarray, names_a: np.ndarray, na: int, rows_b: np.ndarray, names_b: np.ndarray, nb: int) -> np.ndarray:
    """Mask (na, nb) of rows that have a name in common, from (row, name) lists."""
    names, at = np.unique(names_a, return_inverse=True)
    to = np.searchsorted(names, names_b)
    known = to < len(names)
    known[known] = names[to[known]] == names_b[known]
    a, b = np.zeros((na, len(names)), np.float32), np.zeros((nb, len(names)), np.float32)
    a[rows_a, at] = 1
    b[rows_b[known], to[known]] = 1
    return a @ b.T > 0


def links_in_leaf(single: np.ndarray, exact, copies: np.ndarray, known: np.ndarray, split: int | None, least: float, names: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(copies linked, smallest place that links reach) of the rows of a leaf,
    by the pairs at ``least`` that have no name in common. single: unit vectors
    in single precision; exact: those of given places in double; known: rows
    that have a name in common, all of them. names: (row, name), sorted by row."""
    n, band = len(single), margin(single.shape[1])
    count, parent, (rows, name) = np.zeros(n), np.arange(n), names
    for i, j in tiles(known, split):
        s = single[i] @ single[j].T
        linked = s >= least - band
        if split is None and j.start < i.stop:
            linked &= np.arange(j.start, j.stop) > np.arange(i.start, i.stop)[:, None]
        # Cosines that single precision can't tell from the least are computed in double.
        a, b = np.nonzero(linked & (s < least + band))
        for k in range(0, len(a), ROWS):
            u, v = a[k:k + ROWS], b[k:k + ROWS]
            linked[u, v] = (exact(i.start + u) * exact(j.start + v)).sum(axis=1) >= least
        if not linked.any():
            continue
        own, other = (slice(*np.searchsorted(rows, [p.start, p.stop])) for p in (i, j))
        if own.start < own.stop and other.start < other.stop:
            linked &= ~share(rows[own] - i.start, name[own], i.stop - i.start, rows[other] - j.start, name[other], j.stop - j.start)
        dense = linked.astype(np.float64)
        count[i] += dense @ copies[j]
        count[j] += copies[i] @ dense
        a, b = np.nonzero(linked)
        a, b = a + i.start, b + j.start
        while True:
            apart = parent[a] != parent[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(parent, np.maximum(parent[a], parent[b]), np.minimum(parent[a], parent[b]))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return count, parent


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Links: found pairs with cosine >= least_cosine in double precision.
    n_links counts the other rows linked directly, component_id is the
    smallest vec_id that links reach, kept marks that row. Vectors that are
    null, empty, zero or hold null or non-finite components stay alone; so do
    rows with a null id. Equal vectors are one class: compared once, counted
    each. Vectors of different lengths are compared within their length only.
    Other columns are ignored.

    The upper levels of the trees are fitted on the driver on SAMPLE vectors,
    the levels below in Spark on samples of each leaf, in rounds. The driver
    and each Python worker hold the forest: some 25 bytes for each leaf of about
    a thousand rows and each node above. Every vector is indexed. A task gets the rows of a node of
    at most two blocks and goes down to the leaves itself; leaves of more rows
    that lie too close to part are compared block by block in separate tasks.
    A pair that meets in several leaves is counted in the first of them only;
    no pair is ever written, tasks return counts and spanning links. Vectors
    travel in the precision they have; cosines are computed in single precision
    and, where that can't tell, in double.
    """
    with tidy_shuffles(vectors.sparkSession):
        return _near_duplicates(vectors, least_cosine, id_col, vec_col)


def _near_duplicates(vectors: DataFrame, least_cosine: float, id_col: str, vec_col: str) -> DataFrame:
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "embeddings")
    single = isinstance(vectors.schema[vec_col].dataType, T.ArrayType) and vectors.schema[vec_col].dataType.elementType == T.FloatType()
    kind, width = ("f4", 4) if single else ("f8", 8)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v"))

    def parse(batches):
        for whole in batches:
            lengths = np.asarray(whole.column(1).value_lengths().fill_null(0))
            step = max(1, min(ROWS, (8 << 20) // (8 * max(1, int(lengths.max(initial=1))))))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                lists, ids = batch.column(1), batch.column(0)
                lengths = np.asarray(lists.value_lengths().fill_null(0))
                flat, first = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
                known = np.asarray(ids.is_valid())
                rest = np.ones(len(lengths), bool)
                for size in np.unique(lengths[known & (lengths > 0)]):
                    own = np.flatnonzero(known & (lengths == size))
                    x = flat[first[own][:, None] + np.arange(size)].astype(kind)
                    good = usable_rows(x)
                    if not len(good):
                        continue
                    own, x = own[good], x[good]
                    rest[own] = False
                    names = [hashlib.sha256(u).digest()[:16] for u in unit_rows(x)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.array(names, pa.binary()), binary(x)], ["vec_id", "class", "raw"])
                own = np.flatnonzero(rest)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.binary())], ["vec_id", "class", "raw"])

    parsed = scratch.put(rows.mapInArrow(parse, "vec_id long, class binary, raw binary"))
    classes = parsed.filter("class is not null").groupBy("class").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    # Ids may repeat, nodes don't.
    classes = scratch.put(classes.withColumn("node", F.monotonically_increasing_id()))
    members = scratch.put(parsed.select("vec_id", "class"))
    scratch.drop(parsed)

    # The forest.
    limit, drawn = min(2 * LEAF, SPLIT), F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    sizes = {r[0] // width: r[1] for r in classes.groupBy(F.length("raw")).count().collect()}
    n = sum(sizes.values())
    few = max(MIN_LEAF, min(SAMPLE, SAMPLE_BYTES // (width * max(sizes, default=1))))
    forest = Forest()
    for size, count in sorted(sizes.items()):
        # A leaf that holds all is enough.
        forest.add_roots(size, TREES if count > limit else 1, count, limit)
    sample = classes.filter(drawn < few / n).select("raw").collect() if forest.nodes["open"].any() else []
    grown = []
    for size in sorted({len(r[0]) // width for r in sample}):
        x = whole(unit_rows(np.stack([np.frombuffer(r[0], kind) for r in sample if len(r[0]) == width * size])))
        grown += [(root, *fit(x @ directions(size, t), sizes[size], spill(size), limit, 2 * MIN_LEAF, 64))
                  for t, root in enumerate(forest.roots[size]) if forest.nodes["open"][root]]
    del sample
    forest.graft(grown)

    def pick(batches):
        known, pools = sent.value, {}
        for batch in batches:
            for part, size, x in same_length(batch, kind):
                u, x = part.column("u").to_numpy(), whole(x)
                for t, root in enumerate(known["roots"][size]):
                    if not known["live"][root]:
                        continue
                    if (size, t) not in pools:
                        pools[size, t] = directions(size, t)
                    shadow = x @ pools[size, t]
                    row, leaf = descend(known, shadow, root, spill(size), known["rate"] > 0, known["live"])
                    taken = u[row] < known["rate"][leaf]
                    row, leaf = row[taken], leaf[taken]
                    columns = (known["level"][leaf][:, None] * TRIES + np.arange(SPLIT_DEPTH * TRIES)) % POOL
                    yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), binary(shadow[row[:, None], columns].astype("f4"))], ["leaf", "shadow"])

    def refit(table):
        known, leaf = sent.value, table.column("leaf")[0].as_py()
        shadow = stacked(table.column("shadow"), "f4").astype(np.float64)
        least = max(2, SPLIT_SAMPLE >> (SPLIT_DEPTH - 1))
        column, threshold, size = fit(shadow, len(shadow) / float(known["rate"][leaf]), spill(int(known["size"][leaf])), limit, min(least, len(shadow)), SPLIT_DEPTH)
        column = np.array(column, "i2")
        column[column >= 0] = (column[column >= 0] + known["level"][leaf] * TRIES) % POOL
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "column": pa.array([column.tobytes()], pa.binary()),
                         "threshold": pa.array([np.array(threshold, "f8").tobytes()], pa.binary()), "size": pa.array([np.array(size, "f4").tobytes()], pa.binary())})

    while (still := np.flatnonzero(forest.nodes["open"])).size:
        rate = np.zeros(len(forest.nodes["tree"]))
        rate[still] = np.minimum(1, SPLIT_SAMPLE / forest.nodes["rows"][still])
        sent = spark.sparkContext.broadcast(forest.plain(rate=rate, live=forest.above(still)))
        picked = classes.select(drawn.alias("u"), "raw").filter(F.col("u") < float(rate.max())).mapInArrow(pick, "leaf long, shadow binary")
        found = picked.groupBy("leaf").applyInArrow(refit, "leaf long, column binary, threshold binary, size binary").collect()
        # A leaf of which no row is drawn has few.
        forest.nodes["open"][still] = False
        forest.graft([(r[0], np.frombuffer(r[1], "i2"), np.frombuffer(r[2], "f8"), np.frombuffer(r[3], "f4")) for r in found])
        sent.destroy()
    forest.by_tree()

    # Nodes that are dealt out, with the numbers of their blocks and tasks.
    nodes, spread = forest.nodes, max(limit, n // 64)
    block = np.maximum(1, np.minimum(BLOCK, BLOCK_BYTES // np.maximum(1, width * nodes["size"])))
    top, level = [], np.array([r for roots in forest.roots.values() for r in roots], np.int64)
    while len(level):
        end = (nodes["left"][level] < 0) | (nodes["rows"][level] <= np.minimum(2 * block[level], spread))
        top.append(level[end])
        level = np.concatenate([nodes["left"][level[~end]], nodes["left"][level[~end]] + 1])
    top = np.sort(np.concatenate(top)) if top else level
    blocks = np.where((nodes["left"][top] < 0) & (nodes["rows"][top] > block[top]), np.ceil(nodes["rows"][top] / block[top]), 1).astype(np.int64)
    first = np.cumsum(blocks * (blocks + 1) // 2) - blocks * (blocks + 1) // 2
    # Bytes by task, about; a task of two blocks gets both.
    total = int(first[-1] + blocks[-1] * (blocks[-1] + 1) // 2) if len(top) else 0
    of = np.repeat(np.arange(len(top)), blocks * (blocks + 1) // 2)
    weight = nodes["rows"][top][of] * 2 / (blocks[of] + 1) * (width * nodes["size"][top][of] + 48)
    budget = max(PASS_BYTES, PASS_COPIES * sum(c * (width * s + 48) for s, c in sizes.items()))
    starts = [0, *(np.flatnonzero(np.diff(np.cumsum(weight) // budget)) + 1).tolist(), total]
    leaves = nodes["left"] < 0

    def deal(batches):
        known, pools, made = sent.value, {}, sent.value["blocks"]
        stop = np.zeros(len(known["left"]), bool)
        stop[known["top"]] = True
        for batch in batches:
            for part, size, x in same_length(batch, kind):
                x, key = whole(x), mix(part.column("node").to_numpy().view(np.uint64))
                for t, root in enumerate(known["roots"][size]):
                    if not known["live"][root]:
                        continue
                    if (size, t) not in pools:
                        pools[size, t] = directions(size, t, known["levels"])
                    row, at = descend(known, x @ pools[size, t], root, spill(size), stop, known["live"])
                    at = np.searchsorted(known["top"], at)
                    # Each row goes to the tasks of its block and each other block.
                    each = np.repeat(np.arange(len(row)), made[at])
                    other = np.arange(len(each)) - np.repeat(np.cumsum(made[at]) - made[at], made[at])
                    row, at = row[each], at[each]
                    own = (key[row] % made[at].astype(np.uint64)).astype(np.int64)
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    task = known["first"][at] + low * made[at] - low * (low - 1) // 2 + high - low
                    inside = (task >= known["from"]) & (task < known["to"])
                    row, task = pa.array(row[inside]), task[inside]
                    for i in range(0, len(task), ROWS):
                        some = row.slice(i, ROWS)
                        yield pa.RecordBatch.from_arrays([pa.array(task[i:i + ROWS]), *(part.column(c).take(some) for c in ("node", "copies", "raw"))], ["task", "node", "copies", "raw"])

    def compare(table):
        known, task, pools = sent.value, table.column("task")[0].as_py(), {}
        at = int(np.searchsorted(known["first"], task, "right")) - 1
        top, made, step = int(known["top"][at]), int(known["blocks"][at]), task - int(known["first"][at])
        size, tree = int(known["size"][top]), int(known["tree"][top])
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
        raw = stacked(table.column("raw"), kind)
        low = 0
        while step >= made - low:
            step, low = step - (made - low), low + 1
        own = (mix(node.view(np.uint64)) % np.uint64(made)).astype(np.int64)
        # Of two blocks, pairs across them: the lower one stands first.
        order = np.argsort(own, kind="stable")
        node, copies, raw, own = node[order], copies[order], raw[order], own[order]
        cut = int(np.searchsorted(own, low, "right")) if step else None
        x32 = np.empty((len(raw), size), np.float32)

        def shadows(some, trees):
            for i in range(0, len(some), ROWS):
                x = unit_rows(raw[some[i:i + ROWS]])
                x32[some[i:i + ROWS]] = x
                x = whole(x)
                for t in trees:
                    if t not in pools:
                        pools[t] = directions(size, t, known["depth"])
                    yield i, t, x @ pools[t]

        def together(own, here):
            """Mask of the rows of a large leaf that share one earlier leaf, the one that most of them are in."""
            best = np.zeros(len(own), bool)
            for t in range(tree + 1) if len(own) > SPLIT else ():
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for i, _, shadow in shadows(own, [t]):
                    at, name = descend(known, shadow, known["roots"][size][t], spill(size), known["leaves"])
                    found.append((at[name < here] + i, name[name < here]))
                at, name = (np.concatenate(f) for f in zip(*found, strict=True))
                if len(name):
                    names, many = np.unique(name, return_counts=True)
                    if many.max() > best.sum():
                        best = np.zeros(len(own), bool)
                        best[at[name == names[many.argmax()]]] = True
                if best.all():
                    break
            return best

        found = []
        for i, _, shadow in shadows(np.arange(len(raw)), [tree]):
            row, leaf = descend(known, shadow, top, spill(size), known["leaves"])
            found.append((row + i, leaf))
        row, leaf = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((row, leaf))
        row, leaf = row[order], leaf[order]
        near, hit, begin = least_cosine - margin(size), [], np.r_[0, np.flatnonzero(np.diff(leaf)) + 1]
        for own, here in zip(np.split(row, begin[1:]), leaf[begin], strict=True):
            settled = together(own, here)
            order = np.lexsort((settled, own >= (len(raw) if cut is None else cut)))
            own, settled = own[order], settled[order]
            part, some = x32[own], np.zeros(len(own), bool)
            for i, j in tiles(settled, None if cut is None else int((own < cut).sum())):
                s = part[i] @ part[j].T
                if cut is None and i.start == j.start:
                    np.fill_diagonal(s, -2)
                flat = np.flatnonzero(s >= near)
                some[i.start + flat // s.shape[1]] = True
                some[j.start + flat % s.shape[1]] = True
            hit.append((own[some], settled[some], here))
        linked = np.unique(np.concatenate([h[0] for h in hit]))
        out = [(node[:0], node[:0], node[:0])]
        if len(linked):
            # All leaves of these vectors up to this tree: pairs that share an earlier leaf were counted there.
            found = []
            for i, t, shadow in shadows(linked, range(tree + 1)):
                at, name = descend(known, shadow, known["roots"][size][t], spill(size), known["leaves"])
                found.append((at + i, name))
            at, name = (np.concatenate(f) for f in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            at, name = at[order], name[order]
            begin = np.searchsorted(at, np.arange(len(linked) + 1))
        for own, settled, here in hit:
            if not len(own):
                continue
            place = np.searchsorted(linked, own)
            many = begin[place + 1] - begin[place]
            which = np.repeat(np.arange(len(own)), many)
            entry = np.repeat(begin[place], many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            entry, which = entry[name[entry] < here], which[name[entry] < here]
            count, parent = links_in_leaf(x32[own], lambda some, own=own: unit_rows(raw[own[some]]), copies[own], settled,
                                          None if cut is None else int((own < cut).sum()), least_cosine, (which, name[entry]))
            some = np.flatnonzero(count)
            out.append((node[own[some]], count[some].astype(np.int64), node[own[parent[some]]]))
        return pa.table(dict(zip(("node", "n", "root"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    tables = [spark.createDataFrame([], "node long, n long, root long")]
    for start, end in zip(starts[:-1], starts[1:], strict=True) if total else ():
        own = slice(*np.searchsorted(first, [start, max(start, end - 1)], "right") - [1, 0])
        sent = spark.sparkContext.broadcast(forest.plain(top=top, blocks=blocks, first=first, leaves=leaves, live=forest.above(top[own]), levels=int(nodes["level"][top].max()),
                                                      depth=int(nodes["level"].max())) | {"from": start, "to": end})
        dealt = classes.select("node", "copies", "raw").mapInArrow(deal, "task long, node long, copies long, raw binary")
        tables.append(scratch.put(dealt.groupBy("task").applyInArrow(compare, "node long, n long, root long")))
        sent.destroy()

    found = functools.reduce(DataFrame.union, tables)
    comps = scratch.put(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch))
    lowest = comps.join(classes.select("node", "vec_id"), "node").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = scratch.put(comps.join(lowest, "component").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").select("node", "n", "component_id"))
    per_class = scratch.put(classes.select("class", "node", "copies", "vec_id").join(linked, "node", "left").select(
        "class", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))
    scratch.drop(classes, linked, comps)
    joined = members.filter("class is not null").join(per_class, "class").select("vec_id", "n_links", "component_id")
    alone = members.filter("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
