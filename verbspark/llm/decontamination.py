"""Benchmark decontamination: which words of a document repeat windows of benchmark items.

A prefix-filtered containment join.  The windows of an item are its runs of
WINDOW words, or all its words if it has fewer.  A window's shingles (pairs of
neighbouring words) are ordered by how often they occur in the whole corpus,
counted first.  Full containment makes the rarest shingle a necessary prefix:
documents are probed with that shingle alone, its place in the window bounds
where the window must begin and end, and the whole window is then verified
word by word.

The benchmark goes to the executors in blocks of bounded size, measured
beforehand, and documents are never shuffled.  A benchmark of one block takes
one pass to count and one to mark.  Of several blocks each takes two passes,
which write the spans of hit texts only, by the texts' SHA-256; the blocks'
spans are then put together and joined to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import checkpointed, step_path
from .text_kernels import constants, mix64, words

#: Separators of words once A-Z are folded: all of ASCII but letters and digits.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
WINDOW = 10
#: Bytes of benchmark text that are held in memory at once; their index takes about 20 times as much, and is sent to all executors.
BLOCK_BYTES = 4 << 20
#: Up to so many hit texts are sent to all executors; more are joined by a shuffle.
BROADCAST_HITS = 50_000
_PROBE_BITS = 20
_CANDIDATES = 1 << 18


class WindowIndex(NamedTuple):
    """Distinct windows, the items that have them, and the probes that find them."""

    table: np.ndarray  # word hashes, a row per window, 0 beyond its length
    length: np.ndarray
    items: list[str]  # distinct and sorted
    owned: np.ndarray  # owners[owned[i]:owned[i + 1]] are the numbers of the items that have window i
    owners: np.ndarray
    shingles: np.ndarray  # sorted distinct shingles of all windows
    probes: np.ndarray  # sorted distinct rarest shingles
    bounds: np.ndarray  # windows[bounds[i]:bounds[i + 1]] have probe i
    windows: np.ndarray
    offset: np.ndarray  # place of its probe in each window


def _pairs(hashes: np.ndarray) -> np.ndarray:
    f = constants(2, 71) | np.uint64(1)
    with np.errstate(over="ignore"):
        return mix64(hashes[:-1] * f[0] + hashes[1:] * f[1])


def _singles(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(hashes * (constants(1, 73)[0] | np.uint64(1)))


def _window_shingles(table: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each window in a row, and which of them exist; a window of one word has that word alone."""
    with np.errstate(over="ignore"):
        f = constants(2, 71) | np.uint64(1)
        out = mix64(table[:, :-1] * f[0] + table[:, 1:] * f[1]) if table.shape[1] > 1 else np.zeros((len(table), 1), dtype=np.uint64)
    some = np.arange(out.shape[1])[None, :] < np.maximum(length - 1, 1)[:, None]
    single = length == 1
    out[single, 0] = _singles(table[single, 0])
    return out, some


def _lookup_bits(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _PROBE_BITS, dtype=bool)
    bits[values & np.uint64((1 << _PROBE_BITS) - 1)] = True
    return bits


def _find(values: np.ndarray, wanted: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in values that hold a wanted one, and which."""
    at = np.flatnonzero(bits[values & np.uint64((1 << _PROBE_BITS) - 1)])
    which = np.searchsorted(wanted, values[at])
    which[which == len(wanted)] = 0
    real = wanted[which] == values[at] if len(wanted) else np.zeros(0, dtype=bool)
    return at[real], which[real]


def index_windows(items: list[tuple[str, str | None]], size: int) -> WindowIndex:
    """The distinct windows of items; probes are not chosen yet."""
    w = words(pa.array([t for _, t in items], pa.large_string()), SEPARATORS)
    n = np.diff(w.bounds)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))  # windows of each item
    item = np.repeat(np.arange(len(items)), many)
    start = w.bounds[:-1][item] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(n, size)[item]
    at = start[:, None] + np.arange(size)[None, :]
    padded = np.concatenate((w.hashes, np.zeros(size, dtype=np.uint64)))
    table = np.where(np.arange(size)[None, :] < length[:, None], padded[at], np.uint64(0)) if len(start) else np.zeros((0, size), dtype=np.uint64)
    keys = np.ascontiguousarray(np.column_stack((table, length.astype(np.uint64)))).view(f"V{8 * (size + 1)}").ravel()
    _, first, which = np.unique(keys, return_index=True, return_inverse=True) if len(keys) else (None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(names)}
    owner = np.array([number[name] for name, _ in items], dtype=np.int64)[item] if len(items) else item
    pairs = np.unique(which.astype(np.int64) * max(1, len(names)) + owner)
    owned = np.searchsorted(pairs // max(1, len(names)), np.arange(len(first) + 1))
    table, length = table[first], length[first].astype(np.int64)
    values, some = _window_shingles(table, length)
    none = np.zeros(0, dtype=np.int64)
    return WindowIndex(table, length, names, owned, pairs % max(1, len(names)), np.unique(values[some]), np.zeros(0, dtype=np.uint64), none, none, none)


def choose_probes(index: WindowIndex, shingles: np.ndarray, counts: np.ndarray) -> WindowIndex:
    """Each window's rarest shingle in the corpus, the first of equals; shingles that are not among `shingles`, sorted, do not occur."""
    values, some = _window_shingles(index.table, index.length)
    n = np.zeros(values.shape, dtype=np.int64)
    if len(shingles):
        at = np.minimum(np.searchsorted(shingles, values), len(shingles) - 1)
        n = np.where(shingles[at] == values, counts[at], 0)
    offset = np.argmin(np.where(some, n, np.iinfo(np.int64).max), axis=1) if len(values) else np.zeros(0, dtype=np.int64)
    distinct, which = np.unique(values[np.arange(len(values)), offset], return_inverse=True)
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(len(distinct) + 1))
    return index._replace(probes=distinct, bounds=bounds, windows=order, offset=offset)


def occurrences(index: WindowIndex, bits: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window inside a text."""
    begins, found = [], []
    values = [_pairs(hashes)] if len(hashes) > 1 else []
    if (index.length == 1).any():
        values.append(_singles(hashes))
    for value in values:
        at, probe = _find(value, index.probes, bits)
        many = index.bounds[probe + 1] - index.bounds[probe]
        upto = np.cumsum(many)
        lo = 0
        while lo < len(at):  # a bounded number of candidates at once
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _CANDIDATES, side="right")))
            n = many[lo:hi]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = index.windows[np.repeat(index.bounds[probe[lo:hi]], n) + within]
            place = np.repeat(at[lo:hi], n)
            text = np.searchsorted(bounds, place, side="right") - 1
            begin = place - index.offset[window]
            fits = (begin >= bounds[text]) & (begin + index.length[window] <= bounds[text + 1])
            begin, window = begin[fits], window[fits]
            for k in range(index.table.shape[1]):
                longer = k < index.length[window]
                same = hashes[np.where(longer, begin + k, 0)] == index.table[window, k]
                begin, window = begin[same | ~longer], window[same | ~longer]
            begins.append(begin)
            found.append(window)
            lo = hi
    if not begins:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(begins), np.concatenate(found)


def _parts(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some megabytes of text each."""
    at = 0
    while at < b.num_rows:
        n = 512
        while n > 1 and b.column(column).slice(at, n).nbytes > 4 << 20:
            n //= 2
        yield b.slice(at, n)
        at += n


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """Where documents repeat windows of benchmark items.

    Words are runs of ASCII letters and digits and of all characters beyond
    ASCII, with A-Z folded.  Returns for each document its id, n_words, spans
    (array of first word and number of words, disjoint and in order, that
    together are all words inside an occurrence of a window) and items (the
    sorted distinct ids, as strings, of items with an occurring window).

    A null or empty text has no words, so no spans and no items.  Items without
    words have no window; items with a null id count as the item "null".
    Repeated rows each get their result, repeated items count once.  An empty
    benchmark or corpus is no error.  Other columns are not read.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("body"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("body") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    names = list(dict.fromkeys([id_col, *carry]))
    read = list(dict.fromkeys([*names, text_col]))  # a carried text goes to Python once
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(read)))
    body = f"c{read.index(text_col)}"
    kinds = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(names)))
    found = f"n_words long, spans {_SPANS}, items array<string>"
    own_names = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    texts = rows.select(F.col(body).alias("body"))
    if blocks == 1:
        marked = rows.mapInArrow(_marking(rows, _block(texts, items, size), len(names), read.index(text_col)), f"{kinds}, {found}")
        return marked.select(*own_names, "n_words", "spans", "items")
    digest = F.sha2(F.coalesce(F.col(body), F.lit("")), 256).alias("digest")
    path = step_path(docs.sparkSession)
    for block in range(2 * blocks):  # items are dealt by hash: a block has half of the bound on average
        index = _block(texts, items.where(F.pmod(F.xxhash64("item", "body"), F.lit(2 * blocks)) == block), size)
        hit = rows.select(digest, F.col(body).alias("body")).mapInArrow(_marking(rows, index, 1, 1), f"digest string, {found}").where(F.size("spans") > 0)
        hit.write.mode("append").parquet(path)
    hits = docs.sparkSession.read.parquet(path).groupBy("digest").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = checkpointed(hits.select("digest", _merged("spans").alias("spans"), "items"))
    if hits.count() <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    at = len(names)
    counted = rows.select(*(f"c{i}" for i in range(at)), digest, F.col(body).alias("body")).mapInArrow(_marking(rows, index_windows([], size), at + 1, at + 1), f"{kinds}, digest string, {found}")
    out = counted.drop("spans", "items").join(hits, "digest", "left")
    return out.select(*own_names, "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


_SPANS = "array<struct<start: long, length: long>>"


def _merged(spans: str) -> Column:
    """Spans in any order, those that touch as one."""

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["length"], s["start"] + s["length"] - last["start"]).alias("length"))
        touches = F.coalesce(last["start"] + last["length"] >= s["start"], F.lit(False))
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def _block(rows: DataFrame, items: DataFrame, size: int) -> WindowIndex:
    """The index of some items, each window with its rarest shingle among all texts."""
    index = index_windows([(r.item, r.body) for r in items.collect()], size)
    if not len(index.length):
        return index
    seen = rows.select("body").mapInArrow(_counting(rows, index), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    shingles, counts = seen.column("shingle").to_numpy().view(np.uint64), seen.column("n").to_numpy()
    order = np.argsort(shingles)
    return choose_probes(index, shingles[order], counts[order])


def _counting(docs: DataFrame, index: WindowIndex):
    shared = docs.sparkSession.sparkContext.broadcast(index.shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        bits, total = _lookup_bits(wanted), np.zeros(len(wanted), dtype=np.int64)
        for b in batches:
            for part in _parts(b, 0):
                hashes = words(part.column(0), SEPARATORS).hashes
                if len(hashes):
                    for value in (_pairs(hashes), _singles(hashes)):
                        total += np.bincount(_find(value, wanted, bits)[1], minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], names=["shingle", "n"])

    return run


def _marking(docs: DataFrame, index: WindowIndex, names: int, body: int):
    """The first `names` columns of rows are kept, with n_words, spans and items of the text in column `body`."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kinds = [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        bits = _lookup_bits(index.probes)
        for b in batches:
            for part in _parts(b, body):
                yield mark(index, bits, part)

    def mark(index: WindowIndex, bits: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        w = words(part.column(body), SEPARATORS)
        begin, window = occurrences(index, bits, w.hashes, w.bounds) if len(index.probes) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        spans, items = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
        text = np.searchsorted(w.bounds, begin, side="right") - 1
        order = np.argsort(text, kind="stable")
        hit_texts, cuts = np.unique(text[order], return_index=True)
        for k, own in zip(hit_texts.tolist(), np.split(order, cuts[1:])):
            hit = np.zeros(w.bounds[k + 1] - w.bounds[k] + 1, dtype=np.int64)
            first = begin[own] - w.bounds[k]
            np.add.at(hit, first, 1)
            np.add.at(hit, first + index.length[window[own]], -1)
            edge = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(hit) > 0))))
            spans[k] = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2])]
            owners = np.unique(np.concatenate([index.owners[index.owned[v] : index.owned[v + 1]] for v in np.unique(window[own]).tolist()]))
            items[k] = [index.items[i] for i in owners.tolist()]
        columns = [*part.columns[:names], pa.array(np.diff(w.bounds)), pa.array(spans, kinds[0]), pa.array(items, kinds[1])]
        return pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:names], "n_words", "spans", "items"])

    return run
