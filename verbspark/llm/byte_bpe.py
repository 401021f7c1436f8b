"""Byte-level BPE ids for Arrow text columns, from a public tokenizer file.

The vocabulary is read from the tokenizer's JSON file and applied by the
tiktoken library, which gives the same ids as the tokenizers library for this
kind of file (tests compare them).  Texts are cut into pre-tokens with numpy,
and each distinct pre-token is encoded once and remembered, because encoding
is by far the dearest step.  As in the library's default call, the strings of
the file's added tokens are cut out of a text first and become their ids.
Files with settings that this reading would not honour are refused.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import accumulate, chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken

from .text_kernels import constants, mix64, text_buffer

#: The pre-token pattern of this family of byte-level tokenizers: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: Above this code point a text goes to the library's own splitter, whose tables may be of another Unicode version.
_PLAIN_LIMIT = 0x0500
_PLAIN_LEAD = 0xC0 | _PLAIN_LIMIT >> 6
#: Distinct pre-tokens that a process remembers; beyond it starts anew.
_REMEMBERED = 150_000
_PART_BYTES = 1 << 20
_SAFE_CUT = re.compile(r"(?<=\S) ")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character; others move beyond 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.zeros(_PLAIN_LIMIT, dtype=np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\p{White_Space}")):
        match = regex.compile(pattern).match
        out[[c for c in range(_PLAIN_LIMIT) if match(chr(c))]] = kind
    return out


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return constants(256, 41)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """An odd base to the power i, and its inverse modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        base = int(constants(1, 43)[0]) | 1
        _powers.clear()
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(max(n, 1 << 20), b, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the pre-tokens of UTF-8 texts without code points from _PLAIN_LIMIT on.

    Runs of one class of character are found first.  One space before a run of
    another class belongs to that run, any other last white-space character
    before it stands alone, and an apostrophe right at the start of a token
    takes one of the fixed suffixes with it.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)  # bytes that begin a character
    lead = data[at].astype(np.uint16)
    two = lead >= 0xC0
    points = lead
    points[two] = ((lead[two] & 0x1F) << 6) | (data[at[two] + 1] & 0x3F)
    kind = _classes()[points]
    n = len(points)
    first = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])  # characters that begin a text
    begins_text = np.zeros(n + 1, dtype=bool)
    begins_text[first] = begins_text[n] = True
    run = begins_text.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run.copy()
    after = np.flatnonzero(run[1:n] & ~begins_text[1:n] & (kind[:-1] == _SPACE)) + 1  # runs after white space
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    mark = np.flatnonzero(start[:n] & (points == 0x27))
    limit = np.append(first, n)
    room = limit[np.searchsorted(limit, mark, side="right")] - mark if len(mark) else mark
    done = np.zeros(len(mark), dtype=bool)
    for suffix in _SUFFIXES:
        fits = ~done & (room > len(suffix))
        for k, c in enumerate(suffix, 1):
            fits[fits] = points[mark[fits] + k] == ord(c)
        start[mark[fits] + 1] = False
        if len(suffix) == 2:
            start[mark[fits] + 2] = False
        start[mark[fits] + 1 + len(suffix)] = True
        done |= fits
    starts = at[np.flatnonzero(start[:n])]
    return starts, np.append(starts[1:], len(data))


class ByteBpe:
    """Encodes texts to the ids of one tokenizer file."""

    def __init__(self, path: str):
        symbols = _byte_of_symbol()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self._check(model)
        added = {t["content"]: t["id"] for t in model.get("added_tokens") or ()}
        self._added = {text.encode(): number for text, number in added.items()}
        self._cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + b")") if added else None
        vocabulary = model["model"]["vocab"]
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        self._bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    @staticmethod
    def _check(model: dict) -> None:
        """Refuses files that are no plain byte-level BPE."""
        splitter, bpe = model.get("pre_tokenizer") or {}, model["model"]
        plain = splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
        plain = plain and model.get("normalizer") is None and bpe.get("type", "BPE") == "BPE"
        plain = plain and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and not any(t.get(k) for t in model.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not plain:
            raise ValueError("not a plain byte-level BPE file")

    def _forget(self) -> None:
        self._slots: dict[int, int] = {}
        self._ids, self._ends = array("I"), array("q", [0])

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text without added tokens, by the library alone."""
        return np.array(self._bpe.encode_ordinary(text), dtype=np.uint32)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's ids; a null text is empty."""
        data, offsets = text_buffer(column)
        if self._cut and self._cut.search(raw := data.tobytes()):
            return self._encode_cut([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        return self._encode_ordinary(data, offsets)

    def _encode_cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Texts are cut at added tokens, and what is between them is encoded as texts of their own."""
        cut = [self._cut.split(t) for t in texts]  # ordinary, added, ordinary, ...
        flat, bounds = self._encode_ordinary(*text_buffer(pa.array([x for own in cut for x in own[::2]], pa.large_binary())))
        ids, counts, at = [], [], 0
        for own in cut:
            n = 0
            for k, x in enumerate(own):
                got = np.array([self._added[x]], dtype=np.uint32) if k % 2 else flat[bounds[at] : bounds[at + 1]]
                at += k % 2 == 0
                n += len(got)
                ids.append(got)
            counts.append(n)
        return np.concatenate(ids) if ids else flat, np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))

    def _encode_ordinary(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids: list[np.ndarray] = []
        counts = np.zeros(len(offsets) - 1, dtype=np.int64)
        i = 0
        while i < len(counts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PART_BYTES, side="right")) - 1)
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(part) > 2 * _PART_BYTES:  # one very long text
                got = [self._encode_long(part.tobytes().decode())]
                counts[i] = len(got[0])
            elif len(part) and part.max() >= _PLAIN_LEAD:
                got = [self.encode(part[own[k] : own[k + 1]].tobytes().decode()) for k in range(j - i)]
                counts[i:j] = [len(x) for x in got]
            else:
                flat, counts[i:j] = self._encode_plain(part, own)
                got = [flat]
            ids += got
            i = j
        bounds = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(counts, out=bounds[1:])
        return np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32), bounds

    def _encode_long(self, text: str) -> np.ndarray:
        """A very long text in parts: a pre-token always begins at a space that follows a non-space."""
        out, begin = [], 0
        while begin < len(text):
            cut = _SAFE_CUT.search(text, begin + _PART_BYTES // 2)
            end = cut.start() if cut else len(text)
            piece = text[begin:end].encode()
            if len(piece) > 2 * _PART_BYTES:  # no place to cut
                out.append(self.encode(text[begin:end]))
            else:
                out.append(self._encode_ordinary(*text_buffer(pa.array([piece], pa.large_binary())))[0])
            begin = end
        return np.concatenate(out)

    def _encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts below _PLAIN_LIMIT, and how many each text has."""
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets) - 1, dtype=np.int64)
        starts, ends = pre_tokens(data, offsets)
        with np.errstate(over="ignore"):
            up, down = _power_tables(len(data) + 1)
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
            hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        which, distinct = pd.factorize(hashes)
        if len(self._slots) > _REMEMBERED:
            self._forget()
        keys = distinct.tolist()
        slots = np.array(list(map(self._slots.get, keys, repeat(-1))), dtype=np.int64)
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            some = np.zeros(len(keys), dtype=np.int64)
            some[which] = np.arange(len(which))  # an occurrence of each distinct pre-token
            raw, some = data.tobytes(), some[fresh]
            pieces = [raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())]
            encoded = list(map(self._bpe._core_bpe.encode_single_piece, pieces))
            begin = len(self._ends) - 1
            slots[fresh] = np.arange(begin, begin + len(fresh))
            self._slots.update(zip(distinct[fresh].tolist(), range(begin, begin + len(fresh))))
            self._ends.extend(accumulate(map(len, encoded[1:]), initial=self._ends[-1] + len(encoded[0])))
            self._ids.extend(chain.from_iterable(encoded))
        table = np.array(self._ends)
        begin, length = table[slots][which], (table[slots + 1] - table[slots])[which]
        upto = np.cumsum(length)
        ids = np.array(self._ids, dtype=np.uint32)[np.repeat(begin - (upto - length), length) + np.arange(upto[-1])]
        text = np.searchsorted(offsets, starts, side="right") - 1
        return ids, np.bincount(text, weights=length, minlength=len(offsets) - 1).astype(np.int64)


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of a file, loaded once in each process."""
    return ByteBpe(path)
