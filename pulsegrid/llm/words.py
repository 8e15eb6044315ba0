"""Words of whole texts as hashes, in numpy: for the operators that run Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; keeps up to `most` words."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def split_words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased: bytes.split and bytes.lower know ASCII only, as they should."""
    return text.lower().split()


def split_column(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """split_words of a string column, null as empty: all words end to end, as binary, and how many each text has."""
    # ascii_lower loses letters of a slice that was cast; what is taken is no slice.
    whole = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    words, n = lists.flatten().cast(pa.large_binary()), pc.list_value_length(lists).to_numpy().astype(np.int64)
    # Arrow gives an empty word where a text begins or ends with what separates words.
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        n -= np.bincount(np.repeat(np.arange(len(n)), n)[empty], minlength=len(n))
        words = words.filter(pa.array(~empty))
    return words, n


def hash_words(words: list[list[bytes]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and how many each text has."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(n.sum())), n


def shingles(h: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of k words; a text of fewer words, but some, is one shingle."""
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    ends = np.cumsum(n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends - n, count)
    end, s = np.repeat(ends, count), np.zeros(len(text), np.uint64)
    for j in range(k):
        pos = at + j
        s = mix((s ^ np.where(pos < end, h[np.minimum(pos, len(h) - 1)], _GOLD)) + _GOLD) if len(h) else s
    return s, text


def bags(s: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) in order of text, then hash, and how often each occurs."""
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (text[1:] != text[:-1])]) if len(s) else np.zeros(0, np.int64)
    return s[first], text[first], np.diff(np.r_[first, len(s)])


def portions(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Runs of indices whose sizes add up to about `most`; a larger item is a run of its own."""
    start, total = 0, 0
    for i, x in enumerate(sizes):
        if total and total + x > most:
            yield np.arange(start, i)
            start, total = i, 0
        total += int(x)
    if start < len(sizes):
        yield np.arange(start, len(sizes))
