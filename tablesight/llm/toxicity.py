"""Toxicity by class-conditional Kneser-Ney word models.

Two bigram models, of toxic and of ordinary texts, share what they back off
to. For a class c, word w after h:

    P_c(w | h) = max(n_c(h, w) - D, 0) / n_c(h) + rest_c(h) * B_c(w | h)
    B_c(w | h) = max(k(h, w) - D, 0) / k(h)     + rest(h)   * P_c(w)
    P_c(w)     = max(t_c(w) - D, 0) / t_c       + rest_c    * S(w)

n_c: counts in the class; k(h, w): in how many classes h w was seen, and k(h)
the sum of these; t_c(w): number of different words seen before w in the
class; rest: the mass that discounts leave; S: counts of w in all documents of
both kinds, labelled or not. An expression that a class has seldom seen so
costs what it costs in both, or in the corpus, and doesn't tip the scale: words
seen after h once, in one class, differ by a factor under 2 between the classes.
A text's evidence is a mean over all its words of what the log ratio toxic :
ordinary exceeds CLEAR by, zero where it doesn't (smaller and negative ratios
mirror the languages and topics of the sample). So a text repeated has the
evidence of the text. This is not the plain difference of the log-likelihoods
per word: see the README for both, by length of text. A logistic curve fitted on labelled texts that
gave no counts turns it into a score.

Labels enter through at most MAX_LABELLED rows, chosen by a hash of doc_id.
Counts of S cover every document and every word, in a table that grows with
the corpus. The model keeps S and the class counts of all words and bigrams of
the labelled rows, which bound it; for other words S cancels in the ratio.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Words, blocks, mix
from .shared import Scratch, byte_slices, column_bytes

MAX_LABELLED = 20_000
#: S gives one more count to each of so many words, or to each of the corpus'
#: words and one unseen if those are more.
WORD_SLOTS = 1 << 21
#: Words held by a task before their counts are handed on.
HELD_WORDS = 1 << 17
#: Parts in which the driver fetches the bigrams, by the first bits of their hash.
FETCH_BITS = 3
DISCOUNT = 0.75
CLEAR = 2.0
THRESHOLD = 0.3
#: Stands before the first word of a text.
START = np.uint64(1)


def letters() -> np.ndarray:
    """Bytes that make up words here: ASCII letters and digits, and all bytes
    of other characters; everything else separates."""
    table = np.zeros(256, bool)
    table[128:] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        table[a:b] = True
    return table


def word_pairs(texts: list[bytes]):
    """(first, words, before, pairs) of blocks of texts: 64-bit hashes of each
    word, of the word before (START at text begin) and of both together."""
    table = letters()
    for a, b in blocks(texts):
        w = Words(texts[a:b], lower=True, word_byte=table)
        h = w.hashes
        before = np.concatenate([h[:1], h[:-1]])
        starts = w.first[:-1][w.first[:-1] < w.first[1:]]
        before[starts] = START
        yield w.first, h, before, mix(before * np.uint64(0x9DDFEA08EB382D69) + h)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts. A task hands on the counts of HELD_WORDS words
    at a time, so a word enters the shuffle seldom, and memory is bounded."""
    def merged(held):
        word, inverse = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return word, np.bincount(inverse, weights=np.concatenate([n for _, n in held]), minlength=len(word)).astype(np.int64)

    def rows(word, n):
        for i in range(0, len(word), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(word[i:i + 100_000].view(np.int64)), pa.array(n[i:i + 100_000])], ["word", "n"])

    def count(batches):
        held, size = [], 0
        for batch in byte_slices(batches):
            for _, words, _, _ in word_pairs(column_bytes(batch.column(0))):
                held.append(np.unique(words, return_counts=True))
                size += len(held[-1][0])
                if size > 2 * HELD_WORDS:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD_WORDS:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*merged(held))
    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_counts(labelled: DataFrame) -> DataFrame:
    """(pair, before, word, toxic, ordinary): bigram counts of both classes."""
    def count(batches):
        for batch in byte_slices(batches):
            label = batch.column(1).to_numpy().astype(np.int64)
            at = 0
            for first, words, before, pairs in word_pairs(column_bytes(batch.column(0))):
                of = np.repeat(label[at:at + len(first) - 1], np.diff(first))
                at += len(first) - 1
                pair, index, inverse = np.unique(pairs, return_index=True, return_inverse=True)
                n, toxic = np.bincount(inverse, minlength=len(pair)), np.bincount(inverse, weights=of, minlength=len(pair)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (pair, before[index], words[index])), pa.array(toxic), pa.array(n - toxic)],
                    ["pair", "before", "word", "toxic", "ordinary"])
    rows = labelled.select("text", "toxic").mapInArrow(count, "pair long, before long, word long, toxic long, ordinary long")
    return rows.groupBy("pair", "before", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in the sorted keys; len(keys) if it's absent."""
    if not len(keys):
        return np.zeros(np.shape(wanted), np.int64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, place, len(keys))


class ByWord:
    """Values by word hash; the last is that of all words without one."""

    def __init__(self, words: np.ndarray, values: np.ndarray):
        self.words, self.values = words, values

    def __getitem__(self, words):
        return self.values[find(self.words, words)]


class Model:
    """Arrays of the two models and the calibration. Size: 24 bytes a word and
    16 a bigram of at most MAX_LABELLED texts. Plain arrays are broadcast, as
    executors need not have this module.

    words and pairs are sorted hashes; word_p and rest (by class) follow words,
    direct follows pairs, with one more value for what isn't listed. direct
    holds both counted terms of a pair, rest what both levels leave."""

    def __init__(self, arrays: dict | None = None):
        vars(self).update(arrays or {})

    @property
    def word(self) -> list[ByWord]:
        """P_c(w) of both classes, by word hash."""
        return [ByWord(self.words, p) for p in self.word_p]

    def evidence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Evidence per word of each text, and its number of words."""
        out, _, n_words = self.measure(texts)
        return out, n_words

    def measure(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Evidence per word of each text, the difference of its log-likelihoods
        per word (0 without words), and its number of words."""
        out, plain, n_words = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        at = 0
        for first, words, before, pairs in word_pairs(texts):
            k = len(first) - 1
            word, before, pair = find(self.words, words), find(self.words, before), find(self.pairs, pairs)
            ratio = np.log(self.direct[1][pair] + self.rest[1][before] * self.word_p[1][word])
            ratio -= np.log(self.direct[0][pair] + self.rest[0][before] * self.word_p[0][word])
            del words, pairs, word, before, pair
            n = np.diff(first)
            for to in (plain, out):
                if to is out:
                    ratio -= CLEAR
                    np.maximum(ratio, 0, out=ratio)
                total = np.concatenate([[0], np.cumsum(ratio, dtype=np.float64)])[first]
                to[at:at + k] = np.diff(total) / np.maximum(n, 1)
            n_words[at:at + k] = n
            at += k
        return out, plain, n_words

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.judge(texts)[0]

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and its log-likelihoods' difference per word."""
        x, plain, n = self.measure(texts)
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30))), self.prior), plain


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> Model:
    """Learns from the rows of ``labels`` (doc_id, toxic) with crc32(doc_id as
    text) mod 4 other than 2. Null or odd labels are left out; of several for a
    document the toxic one counts."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # At most MAX_LABELLED rows of two numbers: a broadcast of under 1 MB.
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Copies of a text count once (at most MAX_LABELLED texts, by then).
    labelled = scratch.put(texts.join(F.broadcast(chosen), "_id").groupBy(F.sha2("text", 256).alias("_hash"))
                           .agg(F.min("_id").alias("_id"), F.first("text").alias("text"), F.max("toxic").alias("toxic")))
    check = F.pmod(F.xxhash64(F.lit("check"), "_id"), F.lit(5)) == 0
    bigrams = scratch.put(class_counts(labelled.filter(~check)))

    m, kinds = Model(), ("ordinary", "toxic")
    corpus = scratch.put(corpus_counts(docs))
    size = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()
    possible = max(WORD_SLOTS, size.words + 1)
    # One row per word of the labelled texts: in how many kinds of bigrams it is
    # second, how often and in how many kinds first, and its count in the corpus.
    second = bigrams.groupBy("word").agg(*(F.count_if(F.col(k) > 0).alias(f"types_{k}") for k in kinds))
    first = bigrams.groupBy(F.col("before").alias("word")).agg(
        *(F.sum(k).alias(f"n_{k}") for k in kinds), *(F.count_if(F.col(k) > 0).alias(f"after_{k}") for k in kinds), F.count("*").alias("after"))
    by_word = second.join(first, "word", "full").join(corpus, "word", "left").na.fill(0).toArrow()
    words = by_word["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    m.words, column = words[order], lambda name: by_word[name].to_numpy()[order]
    shared = np.append(column("n") + 1, 1) / (size.n + possible)
    # Between a class's bigrams and its words stand the bigrams of both, counted once a class.
    n_both = np.maximum(column("after_ordinary") + column("after_toxic"), 1)
    rest_both = np.where(column("after") > 0, DISCOUNT * column("after") / n_both, 1)
    m.word_p, m.rest, n_before, rests = [], [], [], []
    for k in kinds:
        types = np.append(column(f"types_{k}"), 0)
        total = max(types.sum(), 1)
        kept = np.maximum(types - DISCOUNT, 0) / total
        m.word_p.append((kept + (1 - kept.sum()) * shared).astype(np.float32))
        n_before.append(np.maximum(column(f"n_{k}"), 1))
        rest = np.where(column(f"n_{k}") > 0, DISCOUNT * column(f"after_{k}") / n_before[-1], 1)
        rests.append(rest.astype(np.float32))
        m.rest.append(np.append(rest * rest_both, 1).astype(np.float32))
    del corpus, by_word, words, order, shared, types, kept, rest, rest_both
    # In order of the hash, so that the sorted parts make a sorted whole.
    keys, direct = [np.zeros(0, np.uint64)], ([], [])
    for i in range(1 << FETCH_BITS):
        part = bigrams.filter(F.shiftrightunsigned("pair", 64 - FETCH_BITS) == i).select(
            "pair", "before", *(F.col(k).cast("int").alias(k) for k in kinds)).toArrow()
        key = part["pair"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        keys.append(key[order])
        before = find(m.words, part["before"].to_numpy().view(np.uint64))
        if len(key):
            both = (sum((part[k].to_numpy() > 0).astype(np.int64) for k in kinds) - DISCOUNT) / n_both[before]
            for c, k in enumerate(kinds):
                own = np.maximum(part[k].to_numpy() - DISCOUNT, 0) / n_before[c][before]
                direct[c].append((own + rests[c][before] * both)[order].astype(np.float32))
        del part, key, order, before
    m.pairs = np.concatenate(keys)
    m.direct = [np.concatenate([*d, np.zeros(1, np.float32)]) for d in direct]
    del keys, direct
    calibrate(m, labelled.filter(check).select("text", "toxic"))
    return m


def calibrate(m: Model, labelled: DataFrame) -> None:
    """Logistic curve over the evidence of texts that gave no counts: at most
    MAX_LABELLED rows of two numbers. A weak prior keeps it sane when there are
    few: slope near PRIOR_SLOPE, even odds at PRIOR_CENTER."""
    shared = labelled.sparkSession.sparkContext.broadcast(vars(m))

    def measure(batches):
        model = Model(shared.value)
        for batch in byte_slices(batches):
            x, n = model.evidence(column_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n), batch.column(1).cast(pa.int64())], ["x", "n", "y"])

    rows = labelled.mapInArrow(measure, "x double, n long, y long").filter("n > 0").toArrow()
    shared.destroy()
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    m.prior = float((y.sum() + 1) / (len(y) + 10))
    # Penalized likelihood, by gradient steps that halve until they help.
    base = np.array([PRIOR_SLOPE, -PRIOR_SLOPE * PRIOR_CENTER])
    features = np.stack([x, np.ones(len(x))], 1)

    def loss(beta):
        z = features @ beta
        return np.logaddexp(0, z).sum() - z[y == 1].sum() + 0.5 * (((beta - base) / PRIOR_WIDTH) ** 2).sum()

    beta = base.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        gradient = features.T @ (p - y) + (beta - base) / PRIOR_WIDTH ** 2
        hessian = (features * (p * (1 - p))[:, None]).T @ features + np.diag(1 / PRIOR_WIDTH ** 2)
        step = np.linalg.solve(hessian, gradient)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-9:
            step /= 2
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    m.slope, m.offset = beta


#: In nats per word.
PRIOR_SLOPE, PRIOR_CENTER, PRIOR_WIDTH = 96.0, 0.05, np.array([64.0, 2.0])


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", columns: list[str] | None = None,
          text_of: str | None = None) -> DataFrame:
    """Every row of ``docs`` with held_out, score, predicted (1 if score >=
    THRESHOLD) and log_ratio, the plain difference of both models'
    log-likelihoods per word (0 without words); ``columns`` of docs are kept (default: the id). They must not
    have the names of the results; put such columns into a struct. If the text
    is also a field ``text`` of a kept struct, name that in ``text_of``, and
    each text is sent to Python once.

    Only the text enters the score; equal texts score alike. A null or wordless
    text gets the share of toxic texts among the labelled. A null id counts as
    not held out. Without any labels all scores follow the prior curve.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(vars(fit(docs, labels, scratch, id_col)))
    columns = columns or [id_col]
    inner = [f"c{i}" for i in range(len(columns))]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")) if text_of is None else F.lit("")
    renamed = docs.select(text.alias("_text"), F.coalesce(held_out(id_col), F.lit(False)).alias("_held"),
                          *(F.col(f"`{c}`").alias(i) for c, i in zip(columns, inner)))
    at = None if text_of is None else 2 + columns.index(text_of)

    def texts(batch):
        return batch.column(0) if at is None else batch.column(at).field("text")

    def run(batches):
        model = Model(shared.value)
        for batch in byte_slices(batches, texts):
            score, plain = model.judge(column_bytes(texts(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(1), pa.array(score), pa.array(plain)],
                                             [*inner, "held_out", "score", "log_ratio"])

    schema = T.StructType([*renamed.select(inner).schema, T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
                           T.StructField("log_ratio", T.DoubleType())])
    out = renamed.mapInArrow(run, schema)
    return out.select(*(F.col(i).alias(c) for c, i in zip(columns, inner)), "held_out", "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "log_ratio")
