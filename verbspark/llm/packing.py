"""Packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing: a document is first cut into full windows; the rests of
many documents are sorted by length and each goes to the open window with the
least room that still takes it, found by a segment tree indexed by remaining
capacity.  Rests are packed block by block as a task streams its input, so
neither a shuffle nor more memory than one block is needed, and a lost task
can be run again on its own with the same result.

After a block, windows that still have room are filled up by cutting the
pieces of the emptiest ones.  At most one window a block then stays part
full; it is divided into sequences whose lengths are powers of two, which need
no padding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe

#: A piece while it is packed: number of its document in the block, first token, length.
Piece = tuple[int, int, int]

#: Rests that are packed together, and the tokens after which a block is closed early.
BLOCK_PIECES, BLOCK_TOKENS = 32_768, 8_000_000


class CapacityTree:
    """Open windows by remaining capacity; finds the tightest that has room."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._counts = [0] * (2 * self._leaves)
        self._windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, change: int) -> None:
        node = self._leaves + room
        while node:
            self._counts[node] += change
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self._windows[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the least room >= need."""
        node, counts = self._leaves + need, self._counts
        while not counts[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self._leaves:
            node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self._leaves
        self._add(room, -1)
        return room, self._windows[room].pop()


def best_fit_decreasing(pieces: Iterable[Piece], capacity: int) -> list[list[Piece]]:
    """Puts pieces of at most `capacity` tokens into windows."""
    windows: list[list[Piece]] = []
    tree = CapacityTree(capacity)
    for piece in sorted(pieces, key=lambda p: -p[2]):
        found = tree.take(piece[2])
        if found is None:
            room, window = capacity, len(windows)
            windows.append([])
        else:
            room, window = found
        windows[window].append(piece)
        if room > piece[2]:
            tree.put(room - piece[2], window)
    return windows


def _cut(pieces: list[Piece], length: int) -> tuple[list[Piece], list[Piece]]:
    """The first `length` tokens of a list of pieces, and the rest."""
    taken: list[Piece] = []
    rest = list(pieces)
    while length:
        doc, start, n = rest.pop(0)
        if n > length:
            rest.insert(0, (doc, start + length, n - length))
            n = length
        taken.append((doc, start, n))
        length -= n
    return taken, rest


def fill_up(windows: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Cuts the pieces of the emptiest windows to fill the others, and the last one to powers of two."""
    used = lambda w: sum(p[2] for p in w)
    full = [w for w in windows if used(w) == capacity]
    part = sorted((w for w in windows if used(w) < capacity), key=used)
    low = 0
    while part and low < len(part) - 1:
        room = capacity - used(part[-1])
        give = used(part[low])
        taken, part[low] = _cut(part[low], min(room, give))
        part[-1] = part[-1] + taken
        low += give <= room
        if room <= give:
            full.append(part.pop())
    for rest in part[low:]:
        while rest:
            n = used(rest)
            taken, rest = _cut(rest, 1 << (n.bit_length() - 1))
            full.append(taken)
    return full


class _Packer:
    """Packs the texts of one task as they come."""

    def __init__(self, path: str, capacity: int, end_id: int, first_sequence: int):
        self._bpe, self._capacity, self._end = byte_bpe(path), capacity, end_id
        self._sequence = first_sequence
        self._rests: list[tuple[object, int, int, bytes]] = []
        self._tokens = 0

    def _number(self) -> int:
        self._sequence += 1
        return self._sequence - 1

    def add(self, ids: list, column: pa.Array) -> Iterator[tuple]:
        flat, bounds = self._bpe.encode_column(column)
        for k, doc_id in enumerate(ids):
            own = np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(self._end)).astype("<u4")
            total = len(own)
            whole = total - total % self._capacity
            for start in range(0, whole, self._capacity):
                yield doc_id, start, self._capacity, own[start : start + self._capacity].tobytes(), total, self._number(), 0
            if whole < total:
                self._rests.append((doc_id, whole, total, own[whole:].tobytes()))
                self._tokens += total - whole
            if len(self._rests) >= BLOCK_PIECES or self._tokens >= BLOCK_TOKENS:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        pieces = [(k, 0, total - start) for k, (_, start, total, _) in enumerate(self._rests)]
        for window in fill_up(best_fit_decreasing(pieces, self._capacity), self._capacity):
            sequence, offset = self._number(), 0
            for k, start, n in window:
                doc_id, begin, total, data = self._rests[k]
                yield doc_id, begin + start, n, data[4 * start : 4 * (start + n)], total, sequence, offset
                offset += n
        self._rests, self._tokens = [], 0


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs the tokens of all documents into sequences of at most `capacity` tokens.

    A document is its text's ids and then `end_id`.  Returns a row per piece:
    the document's id under its own name, start (its document's ids before it),
    length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and
    offset in the sequence.

    A null or empty text is a document of one token.  Rows with a null or a
    repeated id are documents of their own, so equal ids are told apart only by
    sequence and offset.  An empty table gives no rows.  Other columns are not
    read.
    """
    id_type = docs.schema[id_col].dataType
    schema = f"{id_col} {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(tokenizer_path, capacity, end_id, TaskContext.get().partitionId() << 40)
        id_kind = None

        def emit(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for row in rows:
                held.append(row)
                if len(held) == 1024:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [id_kind, *kinds])], names=names)

        names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            id_kind = b.schema.field(0).type
            yield from emit(packer.add(b.column(0).to_pylist(), b.column(1)))
        if id_kind is not None:
            yield from emit(packer.flush())

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
