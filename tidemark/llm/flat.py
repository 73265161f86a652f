"""Words of many texts at once: numpy on the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes of text worked on at once; a longer text is a slice of its own
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
SPACE = b" \t\n\v\f\r"
#: ASCII that is neither letter, digit nor apostrophe
PUNCTUATION = bytes(c for c in range(128) if not (chr(c).isalnum() or c == 39))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def byte_codes(fold: bool) -> np.ndarray:
    """A 64-bit code for each byte; ``fold`` gives A-Z the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


@lru_cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for base in (BASE, inverse):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


@dataclass
class Flat:
    """Texts ``first``.. of a batch as one run of bytes; ``offsets`` has one entry more than there are texts."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[Flat]:
    """Cut a string column into runs of about ``most`` bytes; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield Flat(at, data[bounds[at]: bounds[to]], bounds[at: to + 1] - bounds[at])
        at = to


@dataclass
class Words:
    """Words of a slice in order: byte range, text they are in, 64-bit hash."""

    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of the slice."""
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def words(flat: Flat, separators: bytes = SPACE, fold: bool = True) -> Words:
    """Maximal runs of bytes that are no separators, within each text."""
    n = len(flat.data)
    size = 1 << max(12, n.bit_length())
    power, inverse = powers(size) if n <= 2 * SLICE else powers.__wrapped__(size)  # a giant text's tables are not kept
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_codes(fold)[flat.data] * power[:n], out=sums[1:])
    is_separator = np.zeros(256, bool)
    is_separator[list(separators)] = True
    inside = ~is_separator[flat.data]
    edge = np.zeros(n + 1, bool)
    edge[flat.offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (before | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    stop = np.flatnonzero(inside & (after | edge[1:])) + 1
    text = np.searchsorted(flat.offsets, start, "right") - 1
    out = Words(start, stop, text, np.zeros(0, np.uint64), sums, inverse)
    out.hash = out.part(start, stop)
    return out


def shingles(found: Words, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``k`` words; a text of fewer words gives one shingle of all its words."""
    h, text = found.hash, found.text
    count = np.bincount(text, minlength=n_texts)
    texts, hashes = [], []
    for m in range(1, k + 1):
        if m < k:
            at = np.flatnonzero((count[text] == m) & (np.diff(text, prepend=-1) != 0))  # first word of a text of m words
        else:
            at = np.flatnonzero(text[: max(0, len(text) - k + 1)] == text[k - 1:]) if len(text) >= k else np.zeros(0, np.int64)
        x = np.full(len(at), m, np.uint64)
        for j in range(m):
            x = mix(x * BASE + h[at + j])
        texts.append(text[at])
        hashes.append(x)
    return np.concatenate(texts), np.concatenate(hashes)


def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from the lengths and the joined values."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))
