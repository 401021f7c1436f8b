"""Vectorised word splitting and hashing shared by the text operators.

All functions work on the UTF-8 bytes of many texts at once.  A text is read
in blocks of a few hundred kilobytes, cut between words, so the temporary
arrays stay small however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: Characters that separate words for near-duplicate detection: space and \t..\r.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(_BASE))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    """A random word for each byte; A-Z have those of a-z, which folds case."""
    values = constants(256, 17)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64 for i < n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, 2 * _BLOCK)
        with np.errstate(over="ignore"):
            up, down = (np.full(n, b, dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
            up[0] = down[0] = 1
            _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


@lru_cache(8)
def _is_word(separators: bytes) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[np.frombuffer(separators, dtype=np.uint8)] = False
    return out


class Words(NamedTuple):
    """The words of some texts, in order.

    hashes: 64-bit hash of each word, A-Z folded; bounds: the words of text i
    are hashes[bounds[i]:bounds[i + 1]]; prefixes: for each length asked for,
    the hash of the word's first bytes, 0 where the word is shorter.
    """

    hashes: np.ndarray
    bounds: np.ndarray
    prefixes: tuple[np.ndarray, ...] = ()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _blocks(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that cut no word and hold about _BLOCK bytes."""
    begin, size = 0, len(data)
    while begin < size:
        end = min(size, begin + _BLOCK)
        if end < size:
            stop = offsets[np.searchsorted(offsets, end, side="right") - 1]
            at = end
            while at > max(begin, stop) and is_word[data[at - 1]]:
                at -= 1
            if at <= begin:  # a word longer than the block: go on to its end
                limit = offsets[np.searchsorted(offsets, begin, side="right")]
                at = end
                while at < limit and is_word[data[at]]:
                    at += 1
            end = at
        yield begin, end
        begin = end


def words(column: pa.Array, separators: bytes = SPACES, prefix_lengths: tuple[int, ...] = ()) -> Words:
    """Splits every text into its runs of bytes outside separators and hashes them.

    Separators are ASCII, so runs of bytes are runs of characters.  A null or
    empty text has no words.
    """
    data, offsets = text_buffer(column)
    is_word, values = _is_word(separators), _byte_values()
    hashes: list[np.ndarray] = []
    begins: list[np.ndarray] = []
    prefixes: list[list[np.ndarray]] = [[] for _ in prefix_lengths]
    with np.errstate(over="ignore"):
        for a, b in _blocks(data, offsets, is_word):
            part = data[a:b]
            inside = is_word[part]
            first = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a  # texts that begin here
            starts, ends = inside.copy(), inside.copy()
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            starts[first] = inside[first]
            before = first[first > 0] - 1
            ends[before] = inside[before]
            s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
            if not len(s):
                continue
            up, down = _power_tables(b - a + 1)
            sums = np.empty(b - a + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(values[part] * up[: b - a], out=sums[1:])
            base, scale, length = sums[s], down[s], (e - s).astype(np.uint64)
            hashes.append(mix64((sums[e] - base) * scale + length))
            begins.append(s + a)
            for out, k in zip(prefixes, prefix_lengths):
                upto = np.minimum(s + k, e)
                h = mix64((sums[upto] - base) * scale + np.uint64(k + (1 << 32)))
                h[e - s < k] = 0
                out.append(h)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
    bounds = np.searchsorted(join(begins, np.int64), offsets)
    return Words(join(hashes, np.uint64), bounds, tuple(join(p, np.uint64) for p in prefixes))


def shingles(w: Words, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words.

    A text with fewer words, but not none, has its whole sequence as its only
    shingle; a text without words has none.
    """
    factors = constants(size, 29) | np.uint64(1)
    with np.errstate(over="ignore"):
        n = len(w.hashes)
        runs = np.zeros(max(0, n - size + 1), dtype=np.uint64)
        for k in range(size):
            runs += w.hashes[k : n - size + 1 + k] * factors[k] if n >= size else 0
        runs = mix64(runs)
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                few = (w.hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix64(np.array([few], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
