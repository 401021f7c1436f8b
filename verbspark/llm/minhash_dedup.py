"""Near-duplicate groups by a multi-index Hamming join of MinHash signatures.

1. Every text becomes the set of hashes of its distinct word shingles.  Texts
   with equal sets are one node from here on, so copies cost a row each and no
   pairs.
2. A node's signature has CHUNKS * WIDTH symbols, each b bits of one MinHash.
   By the pigeonhole principle two signatures that differ in at most
   CHUNKS * (ERRORS + 1) - 1 symbols differ in at most ERRORS symbols of some
   chunk.  For each chunk every choice of ERRORS symbols to leave out gives a
   key; equal keys are exactly the pairs within that chunk distance.
3. The smallest node of a key's bucket is its centre, and all nodes that share
   a centre form a group; any two nodes with an equal key share a group.
   Groups are split into tiles of bounded size.  All pairs of a tile, and of
   its nodes with the centre, are confirmed on the full sets by matrix
   products.  A tile returns a star for each component of its links.
4. Connected components over these links.  Pairs of one component need no
   further look, so in a group of several tiles only the nodes that are not in
   the centre's component still meet the other tiles.  Work and copies of sets
   are in proportion to the group, unless many of its nodes are unlike its
   centre.
5. Connected components over all links give the result.

A link with similarity 0.75 has the guaranteed distance with probability
0.994, and equals some key, which is all that step 3 needs, with probability
1 - 6e-6; more similar links are missed far more rarely still.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .session import checkpointed
from .text_kernels import constants, mix64, shingles, words

CHUNKS, WIDTH, ERRORS, SYMBOL_BITS = 12, 5, 1, 16
#: A tile holds about so many rows and so many shingles at most, unless one text has more.
TILE_ROWS, TILE_SHINGLES = 256, 400_000
#: Nodes of a task that makes their keys, unless that makes too many tasks.
KEYED_ROWS, MOST_PARTS = 8192, 20_000
#: Up to so many node ids are sent to all executors (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_COLUMNS = 4096


def signature(own: np.ndarray) -> np.ndarray:
    """The MinHash symbols of a set of 64-bit hashes."""
    factors = constants(CHUNKS * WIDTH, 5) | np.uint64(1)
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(own), 4096):
            least = np.minimum(least, (factors[:, None] * own[None, i : i + 4096]).min(axis=1))
        return (mix64(least) >> np.uint64(64 - SYMBOL_BITS)).astype("<u2")


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature its keys: one for each chunk and symbol left out."""
    keys = []
    salts = constants(CHUNKS * WIDTH, 11)
    with np.errstate(over="ignore"):
        for chunk in range(CHUNKS):
            part = signatures[:, chunk * WIDTH : (chunk + 1) * WIDTH].astype(np.uint64)
            for out in range(WIDTH):
                key = np.zeros(len(part), dtype=np.uint64)
                for k in range(WIDTH):
                    if k != out:
                        key = (key << np.uint64(SYMBOL_BITS)) | part[:, k]
                keys.append(mix64(key ^ salts[chunk * WIDTH + out]))
    return np.stack(keys, axis=1)


def _digest(own: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([own.sum(dtype=np.uint64), mix64(own ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64), len(own)], dtype="<u8").tobytes()


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle sets of a column, a few megabytes of text at a time."""
    at = 0
    while at < len(column):
        n = 256
        part = column.slice(at, n)
        while n > 1 and part.nbytes > 8 << 20:
            n //= 2
            part = column.slice(at, n)
        yield from shingles(words(part), size)
        at += n


def _described(size: int):
    """(id, carried..., body) becomes (id, carried..., n, digest, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, signatures = [], [], []
            for own in _sets(b.column(b.num_columns - 1), size):
                sizes.append(len(own))
                digests.append(_digest(own) if len(own) else None)
                signatures.append(signature(own).tobytes() if len(own) else None)
            found = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found], names=[*b.schema.names[:-1], "n", "digest", "signature"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            symbols = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u2").reshape(len(ids), -1)
            keys = chunk_keys(symbols)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, keys.shape[1]))], names=["key", "id"])


def _with_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            held: list[np.ndarray] = []
            for own in _sets(b.column(1), size):
                held.append(own)
                if len(held) >= 64:
                    yield batch(b, at, held)
                    at, held = at + len(held), []
            if held:
                yield batch(b, at, held)

    def batch(b: pa.RecordBatch, at: int, held: list[np.ndarray]) -> pa.RecordBatch:
        sets = pa.array([s.astype("<u8").tobytes() for s in held], pa.binary())
        return pa.RecordBatch.from_arrays([b.column(0).slice(at, len(held)), sets], names=["node", "shingles"])

    return run


def shared_counts(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first `left` sets with all other sets."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    group = np.cumsum(new) - 1
    common = np.bincount(group) > 1
    number = np.cumsum(common) - 1
    keep = common[group]
    column, owner = number[group[keep]], owner[keep]
    out = np.zeros((left, len(sets)), dtype=np.float32)
    for begin in range(0, int(common.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, (begin, begin + _COLUMNS))
        rows, which = np.unique(owner[lo:hi], return_inverse=True)
        dense = np.zeros((len(rows), _COLUMNS), dtype=np.float32)
        dense[which, column[lo:hi] - begin] = 1
        front = np.searchsorted(rows, left)
        out[np.ix_(rows[:front], rows)] += dense[:front] @ dense.T
    return out


def forest(ids: np.ndarray, sets: list[np.ndarray], left: int, per_cent: int) -> list[tuple[int, int]]:
    """The components of the links of the first `left` texts with all of these, each as a star around its first text."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    shared = np.rint(shared_counts(sets, left)).astype(np.int64)
    linked = 100 * shared >= per_cent * (sizes[:left, None] + sizes[None, :] - shared)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(left):
        for j in np.flatnonzero(linked[i]).tolist():
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return [(int(ids[root(j)]), int(ids[j])) for j in range(len(sets)) if root(j) != j]


def _confirmed(per_cent: int):
    """Rows of one tile pair stand together; the first tile's rows come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sides, sets = None, [], [], []

        def links() -> list[tuple[int, int]]:
            left = sides.count(0)
            return forest(np.array(ids), sets, left, per_cent) if left and len(sets) > 1 else []

        found: list[tuple[int, int]] = []
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(6)]
            for centre, i, j, side, node, raw in zip(*columns):
                if (centre, i, j) != now:
                    if now is not None:
                        found += links()
                    now, ids, sides, sets = (centre, i, j), [], [], []
                ids.append(node)
                sides.append(side)
                sets.append(np.frombuffer(raw, dtype="<u8"))
            if len(found) > 4096:
                yield batch(found)
                found = []
        if now is not None:
            found += links()
        if found:
            yield batch(found)

    def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _tiles() -> Column:
    """How many tiles the rows of a group take."""
    return F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")


def _tile_of(tiles: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(tiles)).cast("int")


def _own_tiles(near: DataFrame, extent: DataFrame) -> DataFrame:
    """(centre, i, j, side, node): every node in one tile of each of its groups, the centre in all of them."""
    placed = near.join(extent, "centre")
    tile = F.when(F.col("node") == F.col("centre"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(_tile_of("tiles")))
    return placed.select("centre", F.explode(tile).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), "node")


def _apart(near: DataFrame, labels: DataFrame) -> DataFrame:
    """(centre, node, n, free): whether a node is in another component than the centre of its group."""
    own = labels.select(F.col("id").alias("node"), F.col("label").alias("own"))
    its = labels.select(F.col("id").alias("centre"), F.col("label").alias("its"))
    free = F.coalesce("own", "node") != F.coalesce("its", "centre")
    return near.join(own, "node", "left").join(its, "centre", "left").select("centre", "node", "n", free.alias("free"))


def _other_tiles(apart: DataFrame) -> DataFrame:
    """(centre, i, j, side, node): tiles of free nodes, each to meet itself (j = i), later ones and all tiles of linked nodes (j from `frees` on)."""
    counts = checkpointed(apart.groupBy("centre", "free").agg(_tiles().alias("tiles")))
    frees = counts.where("free").select("centre", F.col("tiles").alias("frees"))
    linked = counts.where("not free").select("centre", F.col("tiles").alias("linked"))
    placed = apart.join(frees, "centre").join(linked, "centre", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    placed = placed.withColumn("tile", F.when(F.col("free"), _tile_of("frees")).otherwise(F.col("frees") + F.pmod(F.xxhash64("node"), F.greatest("linked", F.lit(1))).cast("int")))
    upto = F.when(F.col("free"), F.col("frees") + F.col("linked")).otherwise(F.col("frees"))
    placed = placed.select("centre", "node", "tile", F.explode(F.sequence(F.lit(0), upto - 1)).alias("other"))
    return placed.select("centre", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, per_cent: int = 75, carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups of texts linked by 100 * |A & B| >= per_cent * |A | B| over sets of `size`-word shingles.

    Words are runs of characters other than space and \\t..\\r, with A-Z
    folded.  Returns for each row: id_col, n_shingles, component_id (the
    smallest id reachable by links, its own included), kept (id_col is
    component_id) and the columns of `carry`.

    A text of fewer than `size` words has its whole sequence as its only
    shingle.  A null text, or one without words, has no shingles, is linked
    with nothing and kept.  Rows that repeat an id are compared by their own texts, and
    links found for any of them count for the id.  A row
    with a null id takes no part in links: it gets a null component and is
    kept.  Equal texts are one group at any number.  No rows give no rows.
    Other columns are not read, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *carried, F.col(text_col).alias("body"))
    kinds = "".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(carry)))
    described = checkpointed(rows.mapInArrow(_described(size), f"id long, {kinds}n long, digest binary, signature binary"))
    nodes = checkpointed(
        described.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("node"), F.first("signature").alias("signature"), F.first("n").alias("n"))
    )

    spread = nodes.repartition(min(MOST_PARTS, -(-nodes.count() // KEYED_ROWS)) or 1)  # a node makes many keys
    keys = spread.select("node", "signature").mapInArrow(_keyed, "key long, id long")
    buckets = checkpointed(keys.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre != last").select("key", "centre"))
    near = keys.join(buckets, "key").select("centre", F.col("id").alias("node")).distinct()
    near = checkpointed(near.join(nodes.select("node", "n"), "node").select("centre", "node", "n"))

    def links(placed: DataFrame, of: DataFrame) -> DataFrame:
        wanted = of.select(F.col("node").alias("id")).distinct()
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        sets = texts.join(wanted, "id", "left_semi").mapInArrow(_with_sets(size), "node long, shingles binary")
        tiles = placed.join(sets, "node").select("centre", "i", "j", "side", "node", "shingles")
        tiles = tiles.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "side", "node")
        return tiles.mapInArrow(_confirmed(per_cent), "a long, b long")

    extent = checkpointed(near.groupBy("centre").agg(_tiles().alias("tiles")))
    labels = checkpointed(connected_components(links(_own_tiles(near, extent), near)))
    many = near.join(extent.where("tiles > 1").select("centre"), "centre", "left_semi")
    if not many.isEmpty():
        apart = checkpointed(_apart(many, labels))
        if not apart.where("free").isEmpty():
            apart = apart.join(apart.where("free").select("centre").distinct(), "centre", "left_semi")
            more = links(_other_tiles(apart), apart)
            labels = connected_components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more))
    named = nodes.select("digest", "node").join(labels.withColumnRenamed("id", "node"), "node", "left")
    named = checkpointed(named.select("digest", F.coalesce("label", "node").alias("component")))
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return described.join(named, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry))
    )
