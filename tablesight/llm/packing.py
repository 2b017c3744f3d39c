"""Hierarchical packing of documents into sequences of several lengths.

Documents are tokenized and routed to the smallest context size of TIERS that
holds them; longer ones first fill whole windows of the largest. Windows are
packed from the largest tier down: the longest document opens a window, its
gap takes the longest shorter documents that fit, from its own or shorter
tiers, and what is left of the gap the head of one more, whose rest is routed
again. So every window is full, and its length is a power of two. Sequences of
a tier are dealt into step groups of STEP_TOKENS tokens each.

Packing goes on within a task, over bounded batches, with one window open
between them: no shuffle, and no state that grows with the data.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_slices, column_bytes
from .tokens import cached_encoding, valid_text

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 32_768
END_ID = 1


def pack(lengths: list[int], tiers=TIERS) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows, each a list of pieces (document, start, length), for
    documents 0 .. n-1 of these lengths, and the pieces of the last window if
    nothing is left to fill it. Every token is in exactly one piece."""
    largest, windows, items = tiers[-1], [], []
    for d, n in enumerate(lengths):
        whole = n - n % largest
        windows += [[(d, at, largest)] for at in range(0, whole, largest)]
        if n > whole:
            items.append((n - whole, d, whole))
    items.sort()
    while items:
        n, d, at = items.pop()
        window, gap = [(d, at, n)], next(t for t in tiers if t >= n) - n
        while gap and items:
            fits = bisect_right(items, (gap, len(lengths)))
            if fits:
                n, d, at = items.pop(fits - 1)
                window.append((d, at, n))
                gap -= n
            else:
                n, d, at = items.pop(0)
                window.append((d, at, gap))
                insort(items, (n - gap, d, at + gap))
                gap = 0
        if gap:
            return windows, window
        windows.append(window)
    return windows, []


def tail_windows(rest: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The last pieces of a task, cut into windows of powers of two, the
    largest first: nothing is padded."""
    total, windows, queue = sum(n for *_, n in rest), [], list(reversed(rest))
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        window, gap = [], 1 << bit
        while gap:
            d, at, n = queue.pop()
            window.append((d, at, min(n, gap)))
            if n > gap:
                queue.append((d, at + gap, n - gap))
            gap -= min(n, gap)
        windows.append(window)
    return windows


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, step_group long")


def pack_documents(docs: DataFrame, spec: bytes, tiers=TIERS, id_col: str = "doc_id", text_col: str = "text",
                   step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_tokens, step_group.

    A document's ids are those of its text (null: empty) and END_ID at last,
    so an empty text has one id. Bytes that aren't UTF-8 are replaced by
    U+FFFD first. Pieces of a sequence stand without gaps from
    offset 0. Sequence and step numbers hold the task's number in their upper
    bits, so they are unique without a count over all data. Repeated rows are
    packed each; a null doc_id stays null. Other columns are ignored.

    Bounded memory: a task holds one batch of texts, its ids, and the pieces
    of one unfilled window.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers: growing powers of two")
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        from pyspark import TaskContext
        encoding, _, _ = cached_encoding(shared.value)
        upper = TaskContext.get().partitionId() << 40
        sequences, per_tier, rest = 0, {}, []  # rest: (doc_id, doc_tokens, start, ids)

        def rows(windows, documents):
            nonlocal sequences
            out = []
            for window in windows:
                size, offset = sum(n for *_, n in window), 0
                k = per_tier[size] = per_tier.get(size, -1) + 1
                step = upper | size << 24 | k * size // step_tokens
                for d, at, n in window:
                    doc_id, total, start, ids = documents[d]
                    out.append((doc_id, start + at, n, zlib.crc32(ids[at:at + n].tobytes()), total, upper | sequences, offset, size, step))
                    offset += n
                sequences += 1
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def flush(documents):
            windows, left = pack([len(x[3]) for x in documents], tiers)
            return rows(windows, documents), [
                (documents[d][0], documents[d][1], documents[d][2] + at, documents[d][3][at:at + n].copy()) for d, at, n in left]

        for batch in byte_slices(batches, 1, rows=10_000):
            documents, held = rest, 0
            for doc_id, text in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1)), strict=True):
                ids = np.append(encoding.encode_to_numpy(text.decode(), allowed_special="all"), END_ID).astype("<u4")
                documents.append((doc_id, len(ids), 0, ids))
                held += len(ids)
                if held > 4_000_000:
                    made, documents = flush(documents)
                    held = 0
                    yield made
            made, rest = flush(documents)
            yield made
        yield rows(tail_windows([(d, 0, len(x[3])) for d, x in enumerate(rest)]), rest)

    return docs.select(F.col(f"`{id_col}`").cast("long"), valid_text(docs, text_col)).mapInArrow(run, SCHEMA)
