"""Removal of repeated passages of at least MIN_LENGTH bytes.

Core: threshold-bounded interval expansion on a Burrows-Wheeler transform.
Starting from the intervals of short words, backward extension yields the
intervals of words one byte longer, breadth first. When words of length l + 1
appear, the right ends of new intervals are the places in the suffix array
where the common prefix of neighbours has length l. The expansion stops at
MIN_LENGTH: places that are still open then have common prefixes of at least
that length, and suffixes around them begin with a repeated string.

Distribution: a string of MIN_LENGTH bytes has a least GRAM-byte gram by a
hash (leftmost of equals), wherever it stands. Consecutive strings with the
same gram form a segment. Equal strings have equal grams, so only segments of
one gram need comparing. Segments whose gram occurs once are done. Equal
segments are counted and kept once. What is left, different segments of one
gram, goes to bounded groups by gram, and each group builds its transform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Rolling, mix, runs
from .shared import Scratch, column_bytes

MIN_LENGTH = 200
GRAM = 32
#: Texts are cut into pieces of PIECE bytes for hashing, overlapping by
#: MIN_LENGTH - 1, so that no string is lost and memory stays bounded.
PIECE = 1 << 19
POSITION_BITS = 20
#: Bytes of segments in a task, at a time in memory, and in one transform.
GROUP_BYTES = 4 << 20
DECIDE_BYTES = 2 << 20
TRANSFORM_BYTES = 1 << 20
#: A gram with more different segments than this is split by whole strings, so
#: that no task holds an unbounded group.
MAX_SEGMENTS = 8_000


def segments(texts: list[bytes], length: int = MIN_LENGTH):
    """(text, start, n, gram hash, content hash) arrays of the segments of many
    texts; a segment holds the n strings that begin at start, start + 1, ..."""
    span = length - GRAM + 1
    pieces, size = [], 0
    out = []
    for t, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at:at + PIECE + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > 1 << POSITION_BITS:
                out.append(_segments(pieces, length, span))
                pieces, size = [], 0
            pieces.append((t, at, part))
            size += len(part)
    if pieces:
        out.append(_segments(pieces, length, span))
    return [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 5)]


def _segments(pieces, length, span):
    buf = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    rolling = Rolling(buf)
    grams = rolling.grams(GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    least = (grams & ~np.uint64((1 << POSITION_BITS) - 1)) | place
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:width - span], least[span - width:])
    at = (least & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    # Strings that begin too late in a piece would run into the next one.
    valid = np.ones(len(buf) + 1, bool)
    for e, s in zip(ends, sizes):
        valid[e - min(length - 1, s):e] = False
    valid = valid[:len(at)]
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[1:] |= ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stops = np.append(np.flatnonzero(new | ~valid), len(at))
    last = stops[np.searchsorted(stops, first, "right")]
    piece = np.searchsorted(ends, first, "right")
    text, base = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    start = first - (ends - sizes)[piece] + base[piece]
    return text[piece], start, last - first, grams[at[first]].view(np.int64), rolling.spans(first, last + length - 1).view(np.int64)


def suffix_order(sym: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of strings, by prefix doubling, and whether each
    place but the first starts a new 7-symbol prefix. sym: symbols of the
    strings one after another, each closed by 0; end: per position the position
    of the closing 0. Equal suffixes are in order of position."""
    n = len(sym)
    key, inside = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(7):
        shifted = np.zeros(n, np.int64)
        shifted[:n - k] = sym[k:]
        shifted[~inside] = 0
        inside &= shifted > 0
        key = key << 9 | shifted
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    first_words = new
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h, longest = 7, int((end - np.arange(n)).max()) + 1
    tied = ~(new & np.append(new[1:], True))
    while h < longest and tied.any():
        at = order[tied]  # in rank order; refine each group of ties
        after = at + h
        second = np.where(after <= end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        place = np.argsort(rank[at] * (n + 1) + second, kind="stable")
        at, second, old = at[place], second[place], rank[at][place]
        slot = np.flatnonzero(tied)
        order[slot] = at
        change = np.append(True, (old[1:] != old[:-1]) | (second[1:] != second[:-1]))
        rank[at] = np.maximum.accumulate(np.where(change, slot, 0))
        still = ~(change & np.append(change[1:], True))
        tied = np.zeros(n, bool)
        tied[slot[still]] = True
        h *= 2
    return np.argsort(rank, kind="stable"), first_words


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] of them), first[1], ..."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + sizes, sizes)


def repeated_starts(strings: list[bytes], length: int = MIN_LENGTH) -> np.ndarray:
    """Flags over the concatenated strings, each followed by one closing place:
    the ``length`` bytes from there occur at another place too, all inside one
    string."""
    sizes = np.array([len(s) for s in strings])
    stops = np.cumsum(sizes + 1) - 1
    n = int(stops[-1]) + 1
    sym = np.zeros(n, np.int64)
    inner = np.ones(n, bool)
    inner[stops] = False
    sym[inner] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    end = np.repeat(stops, sizes + 1)
    order, known = suffix_order(sym, end)
    # Burrows-Wheeler transform, and where the suffix one symbol longer stands.
    transform = np.where(order > 0, sym[order - 1], 0)
    step = np.empty(n, np.int64)
    step[np.argsort(transform, kind="stable")] = np.arange(n)
    # known: the common prefix with the suffix before is shorter than the words so far.
    known = known.copy()
    lo = np.flatnonzero(known)
    hi = np.append(lo[1:], n)
    for _ in range(7, length):
        if not len(lo):
            break
        size = hi - lo
        one = size == 1
        at = lo[one]
        at = at[transform[at] > 0]
        begin, close = step[at], step[at] + 1
        if not one.all():
            at = spread(lo[~one], size[~one])
            owner = np.repeat(np.arange(np.count_nonzero(~one)), size[~one])
            symbol = transform[at]
            use = symbol > 0
            at, word = step[at[use]], (owner[use] << 9) | symbol[use]
            by = np.argsort(at)
            at, word = at[by], word[by]
            cut = np.append(True, (word[1:] != word[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
            begin = np.concatenate([begin, at[cut]])
            close = np.concatenate([close, at[np.append(cut[1:], True)] + 1 if len(at) else at])
        fresh = close < n
        fresh[fresh] = ~known[close[fresh]]
        lo, hi = begin[fresh], close[fresh]
        known[hi] = True
    # Suffixes that end before ``length`` bytes share less than that.
    whole = end[order] - order >= length
    same = ~known & whole
    same[1:] &= whole[:-1]
    flags = np.zeros(n, bool)
    flags[order[same]] = True
    flags[order[np.flatnonzero(same) - 1]] = True
    return flags


#: Strings of one segment are compared in blocks by their distance to the gram.
BLOCK_STRINGS = 24


def decide(contents: list[bytes], grams: np.ndarray, copies: np.ndarray, length: int = MIN_LENGTH):
    """(content, first, n): runs of strings, in contents that occur once, that
    occur elsewhere too.

    Contents of a gram are aligned at it, so strings are equal only at the same
    distance. The strings of a block of distances share a core. Equal blocks
    are counted; a block whose core occurs once has no match; different blocks
    with equal cores go through the transform, each once."""
    joined = b"".join(contents)
    sizes = np.array([len(c) for c in contents])
    begins, n = np.cumsum(sizes) - sizes, sizes - length + 1
    rolling = Rolling(np.frombuffer(joined, np.uint8))
    here = rolling.grams(GRAM)
    hit = np.flatnonzero(here == np.repeat(grams.view(np.uint64), sizes)[:len(here)])
    gram_at = hit[np.searchsorted(hit, begins)]  # the first in each content
    anchor = gram_at - begins
    low, high = (anchor - n + 1) // BLOCK_STRINGS, anchor // BLOCK_STRINGS
    content = np.repeat(np.arange(len(contents)), high - low + 1)
    block = spread(low, high - low + 1)
    far = np.minimum(block * BLOCK_STRINGS + BLOCK_STRINGS - 1, anchor[content])
    near = np.maximum(block * BLOCK_STRINGS, (anchor - n + 1)[content])
    first, count = anchor[content] - far, far - near + 1
    start = begins[content] + first
    core = gram_at[content] - block * BLOCK_STRINGS
    place = mix(grams.view(np.uint64)[content] + block.astype(np.uint64))
    whole = mix(rolling.spans(start, start + count + length - 1) ^ place)
    core = mix(rolling.spans(core, core + length - BLOCK_STRINGS + 1) ^ place)
    _, one, of = np.unique(whole, return_index=True, return_inverse=True)
    total = np.bincount(of, weights=copies[content])
    done = (total[of] > 1) & (copies[content] == 1)
    out = [(content[done], first[done], count[done])]

    _, of_core, shared = np.unique(core[one], return_inverse=True, return_counts=True)
    lonely = np.bincount(of_core, weights=total == 1) > 0
    chosen = one[np.flatnonzero((shared > 1)[of_core] & lonely[of_core])]
    chosen = chosen[np.argsort(core[chosen], kind="stable")]
    group = np.flatnonzero(np.append(True, core[chosen][1:] != core[chosen][:-1])) if len(chosen) else chosen
    upto = np.append(0, np.cumsum(count[chosen] + length))
    group = np.append(group, len(chosen))
    a = 0
    while a < len(group) - 1:
        b = max(a + 1, int(np.searchsorted(upto[group], upto[group[a]] + TRANSFORM_BYTES, "right")) - 1)
        part = chosen[group[a]:group[b]]
        strings = [joined[start[i]:start[i] + count[i] + length - 1] for i in part]
        flags = repeated_starts(strings, length)
        at = np.cumsum(count[part] + length) - (count[part] + length)
        flags[spread(at[total[of[part]] > 1], (count[part] + length)[total[of[part]] > 1])] = False
        lo, hi = runs(flags)
        i = np.searchsorted(at, lo, "right") - 1
        out.append((content[part[i]], first[part[i]] + lo - at[i], hi - lo))
        a = b
    return [np.concatenate(c) for c in zip(*out, strict=True)]


OUTPUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]


def cover(size: int, starts, counts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the strings cover: starts and ends."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts - 1 + length, -1)
    return runs(np.cumsum(edge[:-1]) > 0)


def remove_repeats(docs: DataFrame, length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans
    (start and end of each removed run), kept (binary: the bytes left) and the
    columns of ``docs`` that ``carry`` names.

    A byte goes if some string of ``length`` bytes that covers it also starts
    anywhere else, in the same document or another; overlaps count, and all is
    judged on the input. Strings never cross documents. A null text is empty;
    a text shorter than ``length`` stays. Of repeated rows all go, since each
    holds the strings of the other. Other columns are ignored.

    The bytes left need not be valid UTF-8, as a run may begin inside a
    character. Documents are told apart by a 64-bit hash of id and text.
    """
    if length < MIN_LENGTH:
        raise ValueError(f"length must be {MIN_LENGTH} at least")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "suffix")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("row", F.xxhash64("doc_id", "text"))
    carry = carry or []
    if set(carry) & set(OUTPUT):
        raise ValueError(f"carried columns must not be called {OUTPUT}")
    inner = [f"carried{i}" for i in range(len(carry))]
    with_more = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                            *(F.col(f"`{c}`").alias(i) for c, i in zip(carry, inner, strict=True)))
    with_more = with_more.withColumn("row", F.xxhash64("doc_id", "text"))

    def cut_segments(batches):
        for batch in batches:
            texts, key = column_bytes(batch.column(1)), batch.column(0).to_numpy()
            for a in range(0, len(texts), 500):
                text, start, n, gram, content = segments(texts[a:a + 500], length)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(content), pa.array(key[a + text]), pa.array(start, pa.int64()), pa.array(n, pa.int64())],
                                                 ["gram", "content", "row", "start", "n"])

    all_segments = scratch.put(base.select("row", "text").mapInArrow(
        cut_segments, "gram long, content long, row long, start long, n long"))
    # Counts by gram are written, so that both sides of the join are plain
    # shuffles and adaptive execution can split the partition of a hot gram.
    again = scratch.put(all_segments.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").select("gram"))
    alive = scratch.put(all_segments.join(again, "gram", "left_semi"))
    scratch.drop(all_segments, again)
    contents = scratch.put(alive.groupBy("gram", "content").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "n")).alias("one")))
    equal = alive.join(contents.filter("copies > 1").select("gram", "content"), ["gram", "content"], "left_semi").select("row", "start", "n")
    mixed = scratch.put(contents.groupBy("gram").agg(F.count("*").alias("k"), F.min("copies").alias("least"))
                        .filter("k > 1 and least = 1").select("gram", "k"))
    differing = scratch.put(contents.join(mixed, "gram").select("gram", "copies", "k", "one.row", "one.start", "one.n"))

    wanted = differing.groupBy("row").agg(F.collect_list(F.struct("gram", "copies", "k", "start", "n")).alias("cuts"))
    pieces = "gram long, copies long, k long, row long, start long, bytes binary"

    def cut(batches):
        for batch in batches:
            rows, out = batch.column(0).to_pylist(), []
            for row, text, cuts in zip(rows, column_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                out += [(c["gram"], c["copies"], c["k"], row, c["start"], text[c["start"]:c["start"] + c["n"] + length - 1]) for c in cuts]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())],
                                             ["gram", "copies", "k", "row", "start", "bytes"])

    cuts = scratch.put(base.join(wanted, "row").select("row", "text", "cuts").mapInArrow(cut, pieces))
    size = cuts.agg(F.sum(F.length("bytes"))).first()[0] or 0

    def compare(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.concat_tables(tables).combine_chunks().sort_by("gram")
        grams, bytes_ = t["gram"].to_numpy(), t["bytes"].to_pylist()
        upto = np.append(0, np.cumsum([len(b) for b in bytes_]))
        firsts = np.append(np.flatnonzero(np.append(True, grams[1:] != grams[:-1])), len(grams))
        a = 0
        while a < len(firsts) - 1:
            b = max(a + 1, int(np.searchsorted(upto[firsts], upto[firsts[a]] + DECIDE_BYTES, "right")) - 1)
            lo, hi = firsts[a], firsts[b]
            part = t.slice(lo, hi - lo)
            which, first, n = decide(bytes_[lo:hi], grams[lo:hi], part["copies"].to_numpy(), length)
            yield pa.RecordBatch.from_arrays([pa.array(part["row"].to_numpy()[which]), pa.array(part["start"].to_numpy()[which] + first),
                                              pa.array(n, pa.int64())], ["row", "start", "n"])
            a = b

    runs_type = "row long, start long, n long"
    bounded = cuts.filter(F.col("k") <= MAX_SEGMENTS).drop("k").repartition(int(size // GROUP_BYTES) + 1, "gram")
    found = bounded.mapInArrow(compare, runs_type)

    def strings(batches):
        """Every string of the segments of a hot gram: (hash, copies, row, start)."""
        for batch in batches:
            for copies, row, start, b in zip(*(batch.column(c).to_pylist() for c in ("copies", "row", "start", "bytes")), strict=True):
                h = Rolling(np.frombuffer(b, np.uint8)).grams(length)
                k = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(k, copies)), pa.array(np.full(k, row)),
                                                  pa.array(np.arange(start, start + k))], ["string", "copies", "row", "start"])

    hot = cuts.filter(F.col("k") > MAX_SEGMENTS).mapInArrow(strings, "string long, copies long, row long, start long")
    twice = hot.groupBy("string").agg(F.sum("copies").alias("k")).filter("k > 1").select("string")
    hot_found = hot.filter("copies = 1").join(twice, "string", "left_semi").select("row", "start", F.lit(1).cast("long").alias("n"))

    spans = scratch.put(equal.union(found).union(hot_found).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("found")))

    def remove(batches):
        for batch in batches:
            out = []
            for text, found in zip(column_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lo, hi = cover(len(text), np.array([f["start"] for f in found], np.int64), np.array([f["n"] for f in found], np.int64), length) \
                    if found else (np.zeros(0, np.int64),) * 2
                keep, at = [], 0
                for x, y in zip(lo, hi):
                    keep.append(text[at:x])
                    at = y
                keep.append(text[at:])
                out.append((len(text), int((hi - lo).sum()), len(lo), [{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)], b"".join(keep)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], span),
                 pa.array(columns[4], pa.binary()), *batch.columns[3:]], [*OUTPUT, *inner])

    joined = with_more.join(spans, "row", "left").select("doc_id", "text", "found", *inner)
    made = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")
    schema = T.StructType([*made, *joined.select(inner).schema])
    return joined.mapInArrow(remove, schema).withColumnsRenamed(dict(zip(inner, carry)))
