"""k-nearest neighbours over array<float|double> vectors.

Exact search compares every base vector with every query vector, so the
query side must be small: its row count is checked (``max_queries``) before
it is broadcast, and larger query sets are refused rather than truncated.
The work is then |queries| x |base|, linear in the data. Per query only the
k best rows leave each task (``row_number() <= k`` is planned with a partial
WindowGroupLimit). For query sets of any size, ``knn_join`` lets rows meet by
locality-sensitive hashing whose cells are fitted to the data, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

MAX_QUERIES = 10_000
#: Hash tables, and neighbouring cells that each query looks into per table.
TABLES, PROBES = 6, 3
#: Rows that cells are fitted on.
SAMPLE = 2_000
#: Bytes of the vectors of a block.
BLOCK_BYTES = 32 << 20
#: Cells that compare more than this share of all pairs lose neighbours for little.
WORTH = 0.5
#: A table without cells is cut into so many blocks at least, of so many rows at least.
SPREAD, SPREAD_ROWS = 4, 4096
#: Distances held at a time, and columns whose least one is looked at first.
PART, GROUP = 4 << 20, 64


def euclidean(a: str, b: str) -> F.Column:
    return F.sqrt(F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"),
                                         lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def knn(queries: DataFrame, base: DataFrame, k: int, query_id: str = "query_id", base_id: str = "id",
        vector: str = "embedding", max_queries: int = MAX_QUERIES, exclude_self: bool = False) -> DataFrame:
    """``(query_id, rank, id, distance)``: the ``k`` nearest base rows of
    every query by Euclidean distance, ties by id."""
    n = queries.limit(max_queries + 1).count()
    if n > max_queries:
        raise ValueError(f"knn: {n}+ query rows exceed max_queries={max_queries}; use knn_join")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("_qv"))
    b = base.select(F.col(base_id).alias("id"), F.col(vector).alias("_bv"))
    pairs = b.crossJoin(F.broadcast(q)).select("query_id", "id", euclidean("_qv", "_bv").alias("distance"))
    if exclude_self:
        pairs = pairs.filter(F.col("query_id") != F.col("id"))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "distance")


def centroids(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """``(group, embedding)``: mean vector per group (element-wise, partial
    aggregation per (group, position))."""
    cells = df.select(F.col(group).alias("g"), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = cells.groupBy("g", "pos").agg(F.avg("x").alias("x"))
    return (means.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_s"))
                 .select(F.col("g").alias(group), F.transform("_s", lambda s: s["x"]).alias(vector)))


def nearest_to_centroids(df: DataFrame, group: str, k: int, base_id: str = "id",
                         vector: str = "embedding") -> DataFrame:
    """``(<group>, rank, id, distance)``: the ``k`` vectors closest to each
    group's centroid — representative members per class."""
    c = centroids(df, group, vector)
    out = knn(c.withColumnRenamed(group, "query_id"), df, k, "query_id", base_id, vector)
    return out.withColumnRenamed("query_id", group)


def knn_classify(queries: DataFrame, base: DataFrame, k: int, label: str = "label", query_id: str = "query_id",
                 base_id: str = "id", vector: str = "embedding", max_queries: int = MAX_QUERIES) -> DataFrame:
    """``(query_id, prediction, votes)``: majority label among the ``k``
    nearest base rows (ties: smallest label)."""
    nb = knn(queries, base, k, query_id, base_id, vector, max_queries)
    lab = base.select(F.col(base_id).alias("id"), F.col(label).alias("_l"))
    votes = nb.join(lab, "id").groupBy("query_id", "_l").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("query_id").orderBy(F.desc("votes"), "_l")
    return (votes.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
                 .select("query_id", F.col("_l").alias("prediction"), "votes"))


# ---------------------------------------------------------------- all rows against all

@dataclass(frozen=True)
class Hashing:
    """TABLES hash tables of ``projections`` random directions each, cut into
    cells of ``width``. No projections: one bucket, an exact search."""
    projections: int
    width: float
    seed: int = 7

    def cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Hashes (rows, TABLES, 1 + probes) of each row's own cell and of those
        behind the borders it lies nearest to."""
        out = np.zeros((len(x), TABLES, 1 + probes if self.projections else 1), np.int64)
        if not self.projections:
            return out[:, :1]
        rng, every = np.random.default_rng(self.seed), np.arange(len(x))
        for t in range(TABLES):
            at = x @ rng.normal(size=(x.shape[1], self.projections)) / self.width + rng.random(self.projections)
            cell = np.floor(at).astype(np.int64)
            times = rng.integers(1, 1 << 62, self.projections) | 1
            part = at - cell
            nearest = np.argsort(np.minimum(part, 1 - part), axis=1)
            with np.errstate(over="ignore"):
                out[:, t, 0] = (cell * times).sum(1)
                for p in range(min(probes, self.projections)):
                    j = nearest[:, p]
                    out[:, t, p + 1] = out[:, t, 0] + np.where(part[every, j] < .5, -1, 1) * times[j]
                for p in range(self.projections, probes):
                    out[:, t, p + 1] = out[:, t, 0]
        return out


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the k rows of ``y`` nearest to each of
    ``x``, nearest first, ties by place. Vectors holding NaN or infinity come
    last; everything else goes through ``_nearest_finite``."""
    x, y, k = x.astype(np.float64), y.astype(np.float64), min(k, len(y))
    places, away = np.zeros((len(x), k), np.int64), np.zeros((len(x), k))
    if not len(x) or not k:
        return places, away
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.isfinite(y).all(1)
        centre = y[whole].mean(0) if whole.any() else np.zeros(y.shape[1])
        base, asks = (np.isfinite(((v - centre) ** 2).sum(1)) for v in (y, x))
        if base.sum() < k or not y.shape[1]:
            asks[:] = False
        odd = np.flatnonzero(~asks)
        step = max(1, PART // len(y))
        for rows in (odd[i:i + step] for i in range(0, len(odd), step)):
            places[rows], away[rows] = _by_sorting(x[rows], y, k)
    if asks.any():
        base = np.flatnonzero(base)
        # Of equal vectors the first k stand before all others: those are left out.
        _, same = np.unique(np.ascontiguousarray(y[base]).view(np.dtype((np.void, y.shape[1] * 8))).ravel(), return_inverse=True)
        base = base[pd.Series(same).groupby(same).cumcount().to_numpy() < k]
        found, away[asks] = _nearest_finite(x[asks], y[base], k, centre)
        places[asks] = base[found]
    return places, away


def _by_sorting(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    # Near zero the product form is inexact: exact differences for those kept.
    exact = ((x[:, None, :] - y[order]) ** 2).sum(2)
    by = np.argsort(exact, axis=1, kind="stable")
    return np.take_along_axis(order, by, 1), np.take_along_axis(exact, by, 1)


def _nearest_finite(x: np.ndarray, y: np.ndarray, k: int, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` of finite vectors, exact: products in single precision give
    lower bounds of all distances, and only pairs whose bound is not above the
    k-th smallest upper bound are compared in double precision. Where single
    precision leaves too many of them, a part is taken in double."""
    size = max(float(np.sqrt(max(((v - centre) ** 2).sum(1).max() for v in (x, y)))), 1e-150)
    u, v = (x - centre) / size, (y - centre) / size
    sides = {}
    n, width = len(y), y.shape[1]
    groups = -(-n // GROUP)
    step = max(1, PART // (groups * GROUP))
    places, away = [], []
    for i in range(0, len(x), step):
        for kind in (np.float32, np.float64):
            if kind not in sides:
                # (-2 u, 1) . (v, |v|^2) is the distance less |u|^2; |v|^2 is lessened by the error bound.
                error = (width + 8) * float(np.finfo(kind).eps)
                square = np.full(groups * GROUP, 16.0)
                square[:n] = (v * v).sum(1)
                right = np.zeros((groups * GROUP, width + 1), kind)
                right[:n, :width], right[:, width] = v, square * (1 - error)
                sides[kind] = error, square, np.ascontiguousarray(right.T)
            error, square, right = sides[kind]
            part = u[i:i + step]
            low = np.hstack([-2 * part, np.ones((len(part), 1))]).astype(kind) @ right
            # Group g holds the columns g, g + groups, g + 2 groups ...
            cube = low.reshape(len(part), GROUP, groups)
            least = cube.min(1)
            some = np.argpartition(least, min(k, groups) - 1, axis=1)[:, :k]
            columns = np.arange(GROUP) * groups + some[:, :, None]
            high = (np.take_along_axis(low, columns.reshape(len(part), -1), 1) + 2 * error * square[columns].reshape(len(part), -1)).astype(np.float64)
            limit = np.partition(high, k - 1, axis=1)[:, k - 1] + 2 * error * (part * part).sum(1) + float(np.finfo(kind).tiny) * 256
            row, group = np.nonzero(least <= limit[:, None])
            at, member = np.nonzero(cube[row, :, group] <= limit[row, None])
            row, place = row[at], member * groups + group[at]
            if kind is np.float64 or len(row) <= 8 * (k + 8) * len(part):
                break
        mine = x[i:i + step]
        d = np.concatenate([((mine[row[j:j + 65536]] - y[place[j:j + 65536]]) ** 2).sum(1) for j in range(0, len(row), 65536)])
        order = np.lexsort((place, d, row))
        order = order[np.searchsorted(row[order], np.arange(len(part)))[:, None] + np.arange(k)]
        places.append(place[order])
        away.append(d[order])
    return np.concatenate(places), np.concatenate(away)


def fit_hashing(sample: np.ndarray, k: int, recall: float = 0.95) -> tuple[Hashing, float]:
    """Of several numbers of projections and widths those that compare the
    fewest pairs and still find ``recall`` of the k nearest, measured on a
    bounded sample; with it the share of pairs, counted in every table that
    compares them. In a larger table neighbours are nearer, so they are found
    rather more often. Where no cells spare half the work (vectors about as far
    from all others) one bucket remains: an exact search."""
    best = (Hashing(0, 1.0), 1.0)
    queries = sample[:256]
    if len(sample) <= k + 1:
        return best
    places, away = nearest(queries, sample, k + 1)
    scale = np.sqrt(np.median(away[:, -1])) or np.sqrt(np.median(((sample - sample.mean(0)) ** 2).sum(1))) / 8 or 1.0
    for projections in (2, 3, 4, 6, 8, 12):
        for times in (1.0, 2.0, 4.0, 8.0):
            h = Hashing(projections, float(scale * times))
            base, probes = h.cells(sample, 0), h.cells(queries, PROBES)
            met, share = np.zeros((len(queries), len(sample)), bool), 0.0
            for t in range(TABLES):
                here = (probes[:, t, :, None] == base[None, None, :, t, 0]).any(1)
                met |= here
                share += float(here.mean())
            if share < min(best[1], WORTH) and np.take_along_axis(met, places, 1).mean() >= recall:
                best = (h, share)
    return best


def knn_join(queries: DataFrame, base: DataFrame, k: int, query_id: str = "query_id", base_id: str = "id", vector: str = "embedding",
             exclude_self: bool = False, hashing: Hashing | None = None) -> DataFrame:
    """``(query_id, rank, id, distance)``: the ``k`` nearest base rows of every
    query row, for query sets of any size; ids are 64-bit integers, ties go to
    the smallest. Null vectors have no neighbours and are none.

    Rows meet in the cells of a locality-sensitive hashing, each query in its
    own and in PROBES neighbouring ones (``fit_hashing`` on SAMPLE rows chooses
    cells, or none: then all pairs are compared, exactly). Buckets are compared
    in blocks of bounded bytes; a block returns each query's k nearest, not
    pairs. Distances are exact; neighbours that share no cell are missed.
    """
    # Vectors travel in their own precision and are compared in double.
    kind = "array<float>" if {dict(df.dtypes)[vector] for df in (queries, base)} == {"array<float>"} else "array<double>"
    take = lambda df, i: df.select(F.col(i).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).filter("v IS NOT NULL")
    q, b = take(queries, query_id), take(base, base_id)
    if exclude_self:
        q, b = q.filter("id IS NOT NULL"), b.filter("id IS NOT NULL")
    # At most SAMPLE rows, chosen by a hash of the id.
    sample = [r["v"] for r in b.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    if hashing is None:
        hashing = fit_hashing(np.array(sample), k)[0] if sample else Hashing(0, 1.0)
    rows = max(256, BLOCK_BYTES // (8 * max(1, len(sample[0]) if sample else 1)))

    def keyed(df: DataFrame, probes: int) -> DataFrame:
        if not hashing.projections:
            return df.select(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("cell"), "id", "v")

        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    part = batch.slice(i, 4096)
                    cells = hashing.cells(np.array(part.column(1).to_pylist(), np.float64), probes)
                    n, t, p = cells.shape
                    # A row enters a bucket once, though several probes may name it.
                    flat = pd.DataFrame({"row": np.repeat(np.arange(n), t * p), "t": np.tile(np.repeat(np.arange(t), p), n), "cell": cells.ravel()}).drop_duplicates()
                    yield pa.RecordBatch.from_arrays([pa.array(flat["t"].to_numpy(np.int64)), pa.array(flat["cell"].to_numpy()),
                                                      *(part.column(c).take(pa.array(flat["row"].to_numpy())) for c in (0, 1))], ["t", "cell", "id", "v"])
        return df.mapInArrow(run, f"t long, cell long, id long, v {kind}")

    q, b = keyed(q, PROBES), keyed(b, 0)
    if hashing.projections:
        q, b = materialize(q, "knn-queries"), materialize(b, "knn-base")
    counts = lambda df, n: df.groupBy("t", "cell").agg(F.count(F.lit(1)).alias(n))
    least = 1 if hashing.projections else SPREAD
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / rows), F.least(F.lit(least).cast("long"), F.ceil(F.col(n) / SPREAD_ROWS))).alias(n)
    parts = counts(q, "nq").join(counts(b, "nb"), ["t", "cell"]).select("t", "cell", blocks("nq"), blocks("nb"))
    parts = materialize(parts, "knn-buckets")

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(parts, ["t", "cell"]).withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n{own}")))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{other}") - 1))).select("t", "cell", "q", "b", "id", "v")

    both = placed(q, "q", "b").withColumn("asks", F.lit(True)).unionByName(placed(b, "b", "q").withColumn("asks", F.lit(False)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        x, y = pdf[asks], pdf[~asks].sort_values("id")
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        ids, own = y["id"].to_numpy(), x["id"].to_numpy()
        x, y = np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy())
        want, todo, out = k + bool(exclude_self), np.arange(len(x)), []
        while len(todo):
            places, away = nearest(x[todo], y, want)
            found = ids[places]
            # Ids may repeat: more rows are taken until there are k others.
            ordered = np.sort(found, axis=1)
            others = 1 + (ordered[:, 1:] != ordered[:, :-1]).sum(1) - (bool(exclude_self) & (found == own[todo, None]).any(1))
            done = (others >= k) | (want >= len(y))
            out.append(pd.DataFrame({"query_id": np.repeat(own[todo[done]], places.shape[1]), "id": found[done].ravel(), "distance": np.sqrt(away[done].ravel())}))
            todo, want = todo[~done], 2 * want
        return pd.concat(out)

    pairs = both.groupBy("t", "cell", "q", "b").applyInPandas(compare, "query_id long, id long, distance double")
    if exclude_self:
        pairs = pairs.filter("query_id <> id")
    # A pair may meet in several tables. Dealt once, by query, for this and for the ranks.
    pairs = pairs.repartition("query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def knn_approx(base: DataFrame, k: int, base_id: str = "id", vector: str = "embedding") -> DataFrame:
    """Every row's ``k`` nearest other rows (``knn_join`` of a table with itself)."""
    return knn_join(base, base, k, base_id, base_id, vector, exclude_self=True)


@dataclass
class KnnModel:
    """A fitted feature pipeline and the training rows it made."""
    features: object
    base: DataFrame
    kind: str
    k: int

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` (majority label of the nearest, ties: the
        smallest; mean label for regression) and ``score``, the share of label 1."""
        rows = materialize(self.features.transform(df).withColumn("_v", vector_to_array(F.col("features"))).withColumn("_id", F.xxhash64("_v")), "knn-rows")
        # Rows of equal features ask once.
        asked = rows.groupBy("_id").agg(F.first("_v").alias("embedding")).withColumnRenamed("_id", "query_id")
        found = knn_join(asked, self.base, self.k).join(self.base.select("id", "label"), "id")
        if self.kind == "classification":
            votes = found.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
            best = F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"]
            said = votes.groupBy("query_id").agg(best.alias("prediction"), (F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("score"))
        else:
            said = found.groupBy("query_id").agg(F.avg("label").alias("prediction"), F.lit(None).cast("double").alias("score"))
        return rows.join(said.withColumnRenamed("query_id", "_id"), "_id", "left").drop("_id", "_v")


def train_knn(features, rows: DataFrame, kind: str, k: int = 5, label: str = "label"):
    """A k-nearest-neighbours model of the rows of split 'train': ``(model,
    predictions)`` as of ``ml.train``. Training rows count themselves."""
    known = features.transform(rows.filter("split = 'train'")).select(vector_to_array(F.col("features")).alias("embedding"), F.col(label).cast("double").alias("label"))
    # Written, so that the numbers stay.
    base = materialize(known.withColumn("id", F.monotonically_increasing_id()), "knn-train")
    model = KnnModel(features, base, kind, k)
    # Every metric reads the predictions: they are made once.
    pred = materialize(model.transform(rows).select("split", label, "prediction", "score"), "knn-predictions")
    n_classes = base.select("label").distinct().limit(3).count()
    score = F.col("score") if kind == "classification" and n_classes == 2 else F.lit(None).cast("double")
    return model, pred.select("split", F.col(label).cast("double").alias("label"), "prediction", score.alias("score"))
