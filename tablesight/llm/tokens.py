"""Byte-level BPE from a tokenizers JSON file, and exact token counts of every
prefix of a text by dynamic programming.

Prefix counts: the encoding of a byte string ends in one token. Among the
vocabulary tokens t that are a suffix of the prefix p, it is the one that is
compatible with the last token u of p without t: encoding the bytes of u + t
alone gives (u, t) again. Then count(p) = count(p without t) + 1. One pass
over the bytes so gives the count at every prefix, without encoding any of
them. Texts split into units (white space with the word that follows), whose
counts don't depend on the rest of the text, so a unit is solved once per
worker and looked up after that.

The result is one signed byte per byte of text: how much the count changes,
all of a character's change at its first byte. Its running sum at a character
boundary is the token count of that prefix, and inside a character that of the
prefix with the whole character.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import byte_slices, column_bytes, worker_cache

CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The splitting pattern of the ByteLevel pre-tokenizer, with possessive
#: repeats, which can't change a match here and spare backtracking.
PIECES = rf"{CONTRACTIONS}| ?\p{{L}}++| ?\p{{N}}++| ?[^\s\p{{L}}\p{{N}}]++|\s++$|\s+(?!\S)|\s"
#: A white-space run with what follows it; a contraction only counts as such
#: after nothing or white space that doesn't end in a plain space.
UNITS = rf"\s*+(?:\p{{L}}++|\p{{N}}++)|(?:\s*[^\S ])?(?:{CONTRACTIONS})|\s*+[^\s\p{{L}}\p{{N}}]++|\s+"
#: What \\s matches.
WHITE = "\t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000 "
MAX_UNITS = 400_000
MAX_PAIRS = 1_000_000


def read_tokenizer(path: str) -> bytes:
    """The JSON file as bytes, for broadcasting (a few MB, independent of data)."""
    with open(path, "rb") as f:
        return f.read()


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for
    themselves, the others for characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoding(spec: bytes):
    """A tiktoken encoding with the ids of the JSON file: (encoding, ranks)."""
    import tiktoken
    data = json.loads(spec)
    model, pre = data["model"], data["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or data["normalizer"]:
        raise ValueError("only byte-level BPE without normalizer or added space is supported")
    alphabet = _byte_alphabet()
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    order = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if order != sorted(order):
        raise ValueError("ids must grow in the order of the merges")
    return tiktoken.Encoding("json", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special), ranks, special


def cached_encoding(spec: bytes):
    cache = worker_cache()
    if cache.get("spec") != spec:
        cache.clear()
        cache["spec"], cache["encoding"] = spec, load_encoding(spec)
    return cache["encoding"]


def _total(deltas: bytes) -> int:
    return int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64))


class PrefixCounter:
    """deltas(texts): the signed byte strings described above."""

    def __init__(self, spec: bytes):
        import regex
        self.encoding, self.ranks, self.special = cached_encoding(spec)
        self.longest = max(map(len, self.ranks))
        self.find = regex.compile(UNITS).findall
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pairs: dict = {}
        self.units: dict[str, bytes] = {}
        self._piece, self._count, self._last = b"", [0], [0]

    def _compatible(self, key: int, u: int, t: int) -> bool:
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        token = self.encoding.decode_single_token_bytes
        got = self.pairs[key] = self.encoding._encode_single_piece(token(u) + token(t)) == [u, t]
        return got

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token count of piece[:i] for i = 0 .. len(piece). What the piece
        shares with the one before is taken over, so sorted pieces are cheap."""
        n, longest, rank, known = len(piece), self.longest, self.ranks.get, self.pairs.get
        before, k = self._piece, 0
        for x, y in zip(before, piece):
            if x != y:
                break
            k += 1
        count, last = self._count[:k + 1], self._last[:k + 1]
        for i in range(k + 1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = rank(piece[j:i])
                if t is None:
                    continue
                if j:
                    key = last[j] << 20 | t
                    fits = known(key)
                    if fits is None:
                        fits = self._compatible(key, last[j], t)
                    if not fits:
                        continue
                    count.append(count[j] + 1)
                else:
                    count.append(1)
                last.append(t)
                break
        self._piece, self._count, self._last = piece, count, last
        return count.copy()

    def _solve_unit(self, unit: str) -> bytes:
        raw = unit.encode()
        if unit[0] not in WHITE or (unit[0] == " " and (len(unit) > 1 and unit[1] not in WHITE)):
            counts = self.prefix_counts(raw)
            if unit in ("'re", "'ve", "'ll"):
                counts[2] = 2  # cut there, it is no contraction: the quote and a letter
        else:
            rest = unit.lstrip(WHITE)
            run = unit[:len(unit) - len(rest)]
            counts = self.prefix_counts(run.encode())
            if rest:
                # The run but its last character is a piece; that character
                # joins what follows if it is a plain space, else stands alone.
                head = counts[len(run[:-1].encode())]
                if run[-1] == " ":
                    after = self.prefix_counts((" " + rest).encode())[2:]
                else:
                    head += self.prefix_counts(run[-1].encode())[-1]
                    after = self.prefix_counts(rest.encode())[1:]
                    if rest in ("'re", "'ve", "'ll"):
                        after[1] = 2
                counts += [head + c for c in after]
        if len(raw) > len(unit):
            for i in range(len(raw) - 1, 0, -1):
                if raw[i] & 0xC0 == 0x80:  # not at a character boundary
                    counts[i] = counts[i + 1]
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])

    def _plain(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) for t in texts]
        new = set().union(*split).difference(self.units)
        if len(self.units) + len(new) > MAX_UNITS:
            self.units = {}
            new = set().union(*split)
        for unit in sorted(new):
            self.units[unit] = self._solve_unit(unit)
        known = self.units.__getitem__
        return [b"".join(map(known, units)) for units in split]

    def deltas(self, texts: list[str], block: int = 1 << 20) -> Iterator[bytes]:
        """Per text one signed byte per byte, in blocks of about ``block`` characters."""
        begin = size = 0
        for i in range(len(texts) + 1):
            if i == len(texts) or size > block:
                yield from self._block(texts[begin:i])
                begin, size = i, 0
            if i < len(texts):
                size += len(texts[i])

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        plain = self._plain([t if self.split is None or not self.split.search(t) else "" for t in texts])
        for text, done in zip(texts, plain, strict=True):
            yield done if done or not text else self._with_special(text)

    def _with_special(self, text: str) -> bytes:
        """A special token replaces the tokens that its string, but for the
        last character, had as ordinary text after what stands before it."""
        out, at = [], 0
        for m in self.split.finditer(text):
            before, cut = self._plain([text[at:m.start()], text[at:m.end() - 1]])
            closing = 1 + _total(before) - _total(cut)
            out += [cut, bytes([closing & 255])]
            at = m.end()
        return b"".join([*out, *self._plain([text[at:]])])


def valid_text(df: DataFrame, text_col: str):
    """The text, with bytes that aren't UTF-8 replaced as Spark replaces them."""
    return F.make_valid_utf8(F.col(f"`{text_col}`").cast("string"))


def count_prefixes(df: DataFrame, spec: bytes, id_col: str = "doc_id", text_col: str = "text", store: bool = True) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_tokens and, with
    ``store``, prefix_delta (binary): the running sum of its signed bytes is
    the exact token count of every prefix that ends between characters.

    A null text counts as empty: no bytes, no tokens. Bytes that aren't UTF-8
    are replaced by U+FFFD first and counted as such. Strings of special
    tokens inside texts count as one token, as the library does by default.
    Repeated rows get equal results; other columns are ignored. There is no
    shuffle; a text is the unit of work, and batches are cut by bytes.
    """
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def count(batches):
        counter = PrefixCounter(shared.value)
        for batch in byte_slices(batches, 1, rows=10_000):
            texts = column_bytes(batch.column(1))
            deltas, n = [], []
            for d in counter.deltas([t.decode() for t in texts]):
                n.append(_total(d))
                if store:
                    deltas.append(d)
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())]
            if store:
                columns.append(pa.array(deltas, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "prefix_delta"][:len(columns)])

    schema = "doc_id long, n_bytes long, n_tokens long" + (", prefix_delta binary" if store else "")
    return df.select(F.col(f"`{id_col}`").cast("long"), valid_text(df, text_col)).mapInArrow(count, schema)


def store_prefixes(df: DataFrame, spec: bytes, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the table of ``count_prefixes`` as Parquet to ``path`` and return
    it from there: later questions about prefixes read the stored counts and
    never encode again."""
    counted = count_prefixes(df, spec, id_col, text_col)
    counted.write.parquet(path)
    return df.sparkSession.read.schema(counted.schema).parquet(path)


def _from_store(counted: DataFrame, name: str, answer, value) -> DataFrame:
    """``counted`` and the column ``name``: answer(signed bytes, value)."""
    def look_up(batches):
        for batch in byte_slices(batches, lambda b: b.column("prefix_delta"), rows=10_000):
            got = [answer(np.frombuffer(d, np.int8), x) for d, x in
                   zip(batch.column("prefix_delta").to_pylist(), batch.column("_value").to_pylist(), strict=True)]
            yield batch.drop_columns(["_value"]).append_column(name, pa.array(got, pa.int64()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema) + f", {name} long"
    return counted.withColumn("_value", value if isinstance(value, Column) else F.lit(value).cast("long")).mapInArrow(look_up, schema)


def tokens_in_prefix(counted: DataFrame, n_bytes: Column | int) -> DataFrame:
    """Adds prefix_tokens: tokens of the first ``n_bytes`` bytes, read from the
    stored counts; inside a character the whole of it counts, and beyond the
    text the whole text. No bytes or a null: no tokens."""
    return _from_store(counted, "prefix_tokens", lambda d, n: int(d[:max(n or 0, 0)].sum(dtype=np.int64)), n_bytes)


def _longest_within(deltas: np.ndarray, budget: int | None) -> int:
    # Counts can fall where tokens merge, so the last prefix that fits counts, not the first that doesn't.
    fits = np.flatnonzero(np.cumsum(deltas, dtype=np.int64) <= max(budget or 0, 0))
    return int(fits[-1]) + 1 if len(fits) else 0


def bytes_within_budget(counted: DataFrame, budget: Column | int) -> DataFrame:
    """Adds budget_bytes: length of the longest prefix with at most ``budget``
    tokens, read from the stored counts. It ends between characters. A budget
    of none, null or less: no bytes."""
    return _from_store(counted, "budget_bytes", _longest_within, budget)
