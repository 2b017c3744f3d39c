"""Periodic runs of words: stretches that repeat themselves at a fixed lag.

A run of period q and length L >= max(24, 3q) agrees with itself, shifted by
q words, over L - q >= max(16, 2q) words. So it holds equal grams of K words q
apart, for the K of its lag: 16 for lags up to 16, then 32 for lags 17 to 32,
and so on. As q <= K <= 2q (or K = 16), a gram that came again sooner inside
the run would give it a smaller period; so the pairs to look at are each gram's
occurrence and its next one in the document: at most one a word and gram length,
however often a gram occurs.

Each pair is a seed on the diagonal of its lag and extended to both sides as
far as words agree. A table by lag keeps how far the diagonal is covered, and
seeds within are skipped, so a run is extended once.

Everything happens inside a document: no shuffle, and memory is a small
multiple of the longest text.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import mix
from .shared import byte_slices, column_bytes

#: Words of the shortest run, and how often the period must fit.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: Overlap that every run guarantees: min over q of max(24, 3q) - q.
SEED = 16

OUTPUT = ["n_words", "runs", "collapsed"]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers that are equal for equal words and only for them."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many values x and y have in common before they first differ."""
    at, step = 0, 64
    while at < len(x):
        differ = x[at:at + step] != y[at:at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return len(x)


def stretch(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """Widest [a, b) around ``at`` with ids[i] == ids[i + lag] for each i."""
    b = at + agree(ids[at:len(ids) - lag], ids[at + lag:])
    a = at - agree(ids[:at][::-1], ids[lag:at + lag][::-1])
    return a, b


def periodic_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n, found = len(ids), []
    if n < MIN_LENGTH:
        return found
    times = np.uint64(0x9DDFEA08EB382D69)
    gram, width = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while width < SEED:
        gram, width = mix(gram[:-width] * times + gram[width:]), 2 * width
    least = 1
    while True:
        order = np.argsort(gram, kind="stable")
        ordered = gram[order]
        same = ordered[1:] == ordered[:-1]
        if not same.any():  # then no longer gram occurs twice either
            break
        at = order[:-1][same]
        lag = order[1:][same] - at
        pick = (lag >= least) & (lag <= width)
        at, lag = at[pick], lag[pick]
        by = np.lexsort((at, lag))
        at, lag = at[by], lag[by]
        lags, firsts = np.unique(lag, return_index=True)
        for q, seeds in zip(lags.tolist(), np.split(at, firsts[1:])):
            i = 0
            while i < len(seeds):
                a, b = stretch(ids, int(seeds[i]), q)
                if b - a + q >= max(MIN_LENGTH, MIN_PERIODS * q):
                    found.append((a, b - a + q, q))
                # The diagonal is covered up to b.
                i = max(i + 1, int(np.searchsorted(seeds, b)))
        least = width + 1
        if MIN_PERIODS * least > n:
            break
        gram, width = mix(gram[:-width] * times + gram[width:]), 2 * width
    return sorted(found, key=lambda r: (r[0], r[2]))


def keep_first_periods(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def find_runs(docs: DataFrame, columns: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``columns`` of it (default doc_id), n_words,
    runs (array of start, length, period in words, by start and period) and
    collapsed (binary: the words left when each run keeps only its first
    period, joined by one space).

    Words are runs of anything but space, tab and line ends. A run is a stretch
    of consecutive words with smallest period q, of max(24, 3q) words at least,
    that no neighbouring word extends. Null, empty and wordless texts have no
    words, no runs and an empty rest. Repeated rows give repeated results; a
    text that isn't valid UTF-8 is taken as its bytes. Other columns, whatever
    their names, are ignored; those named in ``columns`` must not be called
    like the results.
    """
    columns = columns or ["doc_id"]
    if set(columns) & set(OUTPUT):
        raise ValueError(f"kept columns must not be called {OUTPUT}")
    inner = [f"c{i}" for i in range(len(columns))]
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(i) for c, i in zip(columns, inner)))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches):
        for batch in byte_slices(batches):
            sizes, runs, rest = [], [], []
            for text in column_bytes(batch.column(0)):
                words = text.split()
                found = periodic_runs(word_ids(words))
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                rest.append(b" ".join(compress(words, keep_first_periods(len(words), found)) if found else words))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(runs, run_type), pa.array(rest, pa.binary())],
                                             [*inner, *OUTPUT])

    made = T.StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    schema = T.StructType([*rows.select(inner).schema, *made])
    return rows.mapInArrow(search, schema).withColumnsRenamed(dict(zip(inner, columns)))
