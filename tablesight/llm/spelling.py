"""Spelling variants: words one error apart, found by a bit-sliced position
index.

Vocabulary words are dealt to blocks. In a block, a bitset over its words
stands for each (position, letter): which words have that letter there. Words
are looked up letter by letter; four sets of words follow the lookup, each by
word-parallel operations on whole bitsets:

    Z  no error so far
    S  one letter replaced        S' = (S & B[i]) | (Z & ~B[i])
    I  one letter more in the word, so positions are shifted by one:
                                  I' = (I | Z) & B[i + 1]
    D  one letter less, shifted back:
                                  D' = (D & B[i - 1]) | Z
       and then                   Z' = Z & B[i]

Blocks: let m be half the length of the shorter word of a pair, rounded down.
One error leaves the first m or the last m letters of both equal. So words
meet by their first m letters, and those whose first m differ by their last m:
a pair is found once. Groups of equal halves share blocks of BLOCK_ROWS rows on
average; a group of over GROUP_ROWS is cut into parts, and every two parts make
a block, so that no task holds an unbounded group. No pairs leave a block, only
each word's number of near words and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, byte_slices, column_bytes

MIN_LETTERS, MIN_COUNT = 6, 5
#: A form must be so many times as frequent as its variant.
FORM_TIMES = 5
#: Words and bytes of words held by a task before their counts are handed on.
HELD_WORDS, HELD_BYTES = 1 << 18, 16 << 20
#: Letters of the words of an average block, and of a part of a split group.
BLOCK_LETTERS, GROUP_LETTERS = 1 << 15, 1 << 17
#: Bitset words that a batch of lookups works on at a time.
BATCH_WORDS = 1 << 15


def word_counts(docs: DataFrame, least: int = MIN_LETTERS, alter_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of at least ``least`` letters occurs.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are
    lower-cased. With ``alter_every`` a run loses its letter h % length first,
    where that number divides h, the crc32 of "<doc_id>:<run>"; rows of a null
    id are left as they are. Null and empty texts have no words; bytes that
    aren't UTF-8 separate words; repeated rows count again.
    """
    # Words are handled in Latin-1, where each letter is one byte; "?" separates.
    pattern = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def handed_on(held):
        words = list(held)
        for i in range(0, len(words), 50_000):
            part = words[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()),
                                              pa.array([held[w] for w in part], pa.int64())], ["word", "n"])

    def count(batches):
        held, size = {}, 0
        for batch in byte_slices(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1)), strict=True):
                seen = Counter(pattern.findall(text.decode("utf-8", "replace").encode("latin-1", "replace").lower()))
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in seen.items():
                    if alter_every and doc is not None:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % alter_every == 0:
                            cut = h % len(word)
                            word = word[:cut] + word[cut + 1:]
                            if len(word) < least:
                                continue
                    if word in held:
                        held[word] += n
                    else:
                        held[word] = n
                        size += len(word)
                if len(held) > HELD_WORDS or size > HELD_BYTES:
                    yield from handed_on(held)
                    held, size = {}, 0
        yield from handed_on(held)

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class BitSlices:
    """Bitsets over words (byte strings), by position and letter."""

    def __init__(self, words: list[bytes]):
        self.n, self.width = len(words), -(-len(words) // 64)
        self.lengths = np.array([len(w) for w in words])
        longest = int(self.lengths.max())
        letters = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(self.n, longest)
        # Letters are numbered from 1 as they are used; 0 is none.
        used = np.unique(letters)
        number = np.zeros(256, np.int64)
        used = used[used > 0]
        number[used] = np.arange(1, len(used) + 1)
        self.codes = number[letters]
        self.bits = np.zeros((longest + 1, len(used) + 1, self.width), np.uint64)
        every = np.arange(self.n)
        for i in range(longest):
            has = np.zeros((len(used) + 1, self.width * 64), bool)
            has[self.codes[:, i], every] = True
            has[0] = False
            self.bits[i] = pack(has)

    def having(self, mask: np.ndarray) -> np.ndarray:
        """Bitset of the words where ``mask`` is true."""
        out = np.zeros(self.width * 64, bool)
        out[:self.n] = mask
        return pack(out)

    def near(self, rows: np.ndarray, allowed, half: int) -> tuple[np.ndarray, np.ndarray]:
        """For words ``rows``, all of one length: bitsets of the words one error
        away whose length ``allowed`` takes, and of those with the same first
        ``half`` letters."""
        n = int(self.lengths[rows[0]])
        of_length = {k: self.having(self.lengths == k) for k in (n - 1, n, n + 1) if allowed(k)}
        zero = np.broadcast_to(self.having(np.ones(self.n, bool)), (len(rows), self.width))
        replaced = more = less = np.zeros((len(rows), self.width), np.uint64)
        same_half = zero
        for i in range(n):
            letter = self.codes[rows, i]
            here = self.bits[i][letter]
            before = self.bits[i - 1][letter] & less if i else less
            replaced = (replaced & here) | (zero & ~here)
            more = (more | zero) & self.bits[i + 1][letter]
            less = before | zero
            zero = zero & here
            if i + 1 == half:
                same_half = zero
        none = np.zeros(self.width, np.uint64)
        found = (replaced & of_length.get(n, none)) | ((more | zero) & of_length.get(n + 1, none)) | (less & of_length.get(n - 1, none))
        return found, same_half

    def first_letters(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Bitsets of the words with the first ``k`` letters of words ``rows``."""
        out = np.broadcast_to(self.having(np.ones(self.n, bool)), (len(rows), self.width))
        for i in range(k):
            out = out & self.bits[i][self.codes[rows, i]]
        return out


def pack(mask: np.ndarray) -> np.ndarray:
    return np.packbits(mask, axis=-1, bitorder="little").view(np.uint64)


def search_block(words: list[bytes], half: int, from_end: bool, part: np.ndarray | None = None):
    """For each word (index) that has near words in this block: their number
    and the index of the first of them. Pairs count if ``half`` is half the
    shorter word and they share their first ``half`` letters; with ``from_end``
    their last, and not their first. With ``part``, both must be of other parts."""
    own = BitSlices(words if not from_end else [w[::-1] for w in words])
    forward = BitSlices(words) if from_end else None
    at, counts, best = [], [], []
    for n in np.unique(own.lengths):
        every = np.flatnonzero(own.lengths == n)
        step = max(1, BATCH_WORDS // own.width)
        for i in range(0, len(every), step):
            rows = every[i:i + step]
            found, same = own.near(rows, lambda k: min(k, int(n)) // 2 == half, half)
            found = found & same
            if from_end:
                found &= ~forward.first_letters(rows, half)
            if part is not None:
                for p in np.unique(part[rows]):
                    found[part[rows] == p] &= ~own.having(part == p)
            some = found.any(axis=1)
            rows, found = rows[some], found[some]
            word = (found != 0).argmax(axis=1)
            bits = found[np.arange(len(found)), word]
            low = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)) if len(bits) else bits
            at.append(rows)
            counts.append(np.bitwise_count(found).sum(axis=1, dtype=np.int64))
            best.append(word * 64 + low.astype(np.int64))
    return tuple(np.concatenate(x) for x in (at, counts, best))


def near_words(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n_near, near_n, near_word): of each word of (word, n) that has
    near words, their number and the most frequent (ties: the smallest)."""
    length = F.length("word")
    halves = F.array_distinct(F.array(*(F.floor((length - k) / 2).cast("int") for k in (0, 1))))
    keyed = vocabulary.select("word", "n", F.explode(halves).alias("half"))
    keyed = keyed.filter("half > 0").select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("from_end"))
    keyed = keyed.select("*", F.xxhash64("half", F.when(F.col("from_end"), F.expr("right(word, half)")).otherwise(F.expr("left(word, half)"))).alias("key"))
    keyed = scratch.put(keyed)
    groups = scratch.put(keyed.groupBy("half", "from_end", "key").agg(F.count("*").alias("size")).filter("size > 1"))
    letters = groups.agg(F.sum(F.col("size") * (F.col("half") + 1) * 2)).first()[0] or 0
    n_blocks = letters // BLOCK_LETTERS + 1
    # Words of a part of a split group: fewer, the longer they are.
    most = F.greatest(F.lit(64), F.floor(F.lit(GROUP_LETTERS) / ((F.col("half") + 1) * 2)))
    parts = F.ceil(F.col("size") / most)
    groups = groups.select("half", "from_end", "key", parts.alias("parts"),
                           F.when(parts > 1, F.col("key")).otherwise(F.pmod("key", F.lit(n_blocks))).alias("block"))
    dealt = keyed.join(groups, ["half", "from_end", "key"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("word", "n", "half", "from_end", "block", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "word"], ascending=[False, True])
        words, n = pdf["word"].to_numpy(), pdf["n"].to_numpy()
        split = pdf["low"].iat[0] != pdf["high"].iat[0]
        at, counts, best = search_block([w.encode("latin-1") for w in words], int(pdf["half"].iat[0]), bool(pdf["from_end"].iat[0]),
                                        pdf["part"].to_numpy() if split else None)
        return pd.DataFrame({"word": words[at], "n_near": counts, "near_n": n[best], "near_word": words[best]})

    found = dealt.groupBy("half", "from_end", "block", "low", "high").applyInPandas(search, "word string, n_near long, near_n long, near_word string")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near_word")).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", (-F.col("first.less")).alias("near_n"), F.col("first.near_word").alias("near_word"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): the end of each chain of (word, form). Forms grow in
    frequency by FORM_TIMES at least, so chains are short and end; each round
    halves what is left of them."""
    links = scratch.put(links.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = scratch.put(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = longer.select("word", "root")
        if not longer.filter("moved").limit(1).count():
            return links


def variants(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Groups the words of ``counts`` (word, n) that occur ``min_count`` times
    or more: word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced letter turns one
    into the other. form is the near word of largest n (ties: the smallest) if
    that is FORM_TIMES the word's n at least, else null, as form_n is; root is
    where forms lead in the end, the word itself without one. Words must have
    two letters or more, of U+0001 to U+00FF; null words and counts are left
    out; a word of several rows has the sum of their counts.
    """
    scratch = Scratch(counts.sparkSession, "spelling")
    counts = counts.filter("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    vocabulary = scratch.put(counts.filter(F.col("n") >= min_count))
    near = near_words(vocabulary, scratch)
    is_form = F.col("near_n") >= FORM_TIMES * F.col("n")
    out = vocabulary.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("near_word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near_n")).alias("form_n"))
    out = scratch.put(out)
    ends = roots(out.filter("form is not null"), scratch)
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
