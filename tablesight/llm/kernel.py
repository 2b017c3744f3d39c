"""NumPy text kernels for use inside tasks: they work on the bytes of many
texts at once, in blocks of bounded size, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator: spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * BASE + np.uint64(salt)) | np.uint64(1)


class Rolling:
    """Polynomial hashes of substrings of one buffer, modulo 2**64.

    Each byte stands for a random 64-bit value, so that the structure of the
    text doesn't meet the structure of the modulus."""

    _bytes = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
    _pow = np.ones(1, np.uint64)
    _inv = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> None:
        if len(cls._pow) < n:
            size = max(n, 1 << 16)
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            for name, base in (("_pow", BASE), ("_inv", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self._powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self._bytes[buf] * self._pow[:n], out=self.prefix[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self._inv[starts])

    def grams(self, width: int) -> np.ndarray:
        n = len(self.prefix) - width
        return mix((self.prefix[width:] - self.prefix[:n]) * self._inv[:n])


#: True for bytes that belong to a word of the contracts.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def blocks(texts: list[bytes], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together, or one text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


class Words:
    """Word hashes of a block of texts; ``first[i]:first[i+1]`` are text i's."""

    def __init__(self, texts: list[bytes], lower: bool, word_byte: np.ndarray = NOT_SPACE):
        joined = b"\n".join(texts)
        self.buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        self.starts, self.ends = runs(word_byte[self.buf])
        self.hashes = Rolling(self.buf).spans(self.starts, self.ends)
        self.text_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.text_at[1:])
        self.first = np.searchsorted(self.starts, self.text_at)

    def windows(self) -> np.ndarray:
        """Hash of the five words that begin at each word, whatever the text."""
        n = len(self.hashes)
        out = np.zeros(max(0, n - SHINGLE_WORDS + 1), np.uint64)
        for k, c in enumerate(seeds(SHINGLE_WORDS, 5)):
            out += self.hashes[k:k + len(out)] * c
        return mix(out)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its 5-word shingles, lower-cased;
    with fewer words one hash of the whole sequence, without words none."""
    short = seeds(SHINGLE_WORDS, 9)
    for a, b in blocks(texts):
        w = Words(texts[a:b], lower=True)
        all_windows = w.windows()
        for i in range(b - a):
            lo, hi = w.first[i], w.first[i + 1]
            n = hi - lo
            if n >= SHINGLE_WORDS:
                yield np.unique(all_windows[lo:hi - SHINGLE_WORDS + 1])
            elif n:
                yield mix((w.hashes[lo:hi] * short[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                yield w.hashes[:0]
