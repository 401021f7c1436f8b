"""Exact top-k by inner product over integer vectors.

Queries are packed into blocks and candidates into shards, one matrix a row,
in the smallest integers that hold it.  Query blocks go out in waves of
bounded size; every shard meets every block of the wave in one matrix product,
from which the k best of each query are selected, and a task merges its
shards' lists as it goes.  The tasks' lists are then merged in two rounds of a
tree, so that no task reads the lists of all others at once.  Where there are
several waves, the shards are written once and each wave's lists are written
before the next begins, so that no plan grows with the number of waves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed, step_path

#: Rows of a shard, rows of a query block, and query rows that are sent out at once.
SHARD_ROWS, BLOCK_ROWS, WAVE_ROWS = 4096, 256, 16_384
#: Bytes of query vectors that are sent out at once, at most.
WAVE_BYTES = 32 << 20
#: Lists that are merged together in the first round.
FAN_IN = 32
_EXACT_FLOAT = 2**53


def quantised(vectors: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """Replaces each component x by floor(scale * x), x as double.

    Rows whose vector is null or holds a null or a non-finite component are
    left out.  Components beyond 64 bits once scaled are held at the limit, as
    scores are.
    """
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.where(F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.withColumn(vector_col, F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)))


def _small(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest of 2, 4 or 8 bytes."""
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    size = next(n for n in (2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1)
    return matrix.astype(f"<i{size}")


def _matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    """A packed matrix; vectors without components have no bytes."""
    size = len(data) // (rows * dim) if rows * dim else 8
    return np.frombuffer(data, dtype=f"<i{size}").reshape(rows, dim)


def _blocks(wave: list[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, matrix) of at most BLOCK_ROWS queries, small blocks of one dimension put together."""
    for dim in sorted({d for d, _, _ in wave}):
        ids = [np.frombuffer(x, dtype="<i8") for d, x, _ in wave if d == dim]
        matrix = np.concatenate([_matrix(x, len(n), dim) for n, x in zip(ids, (x for d, _, x in wave if d == dim))])
        ids = np.concatenate(ids)
        for at in range(0, len(ids), BLOCK_ROWS):
            yield dim, ids[at : at + BLOCK_ROWS], matrix[at : at + BLOCK_ROWS]


def _packed(rows: int):
    """Turns rows of (id, vector) into rows of (dim, ids, matrix) of at most `rows` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, data = zip(*held.pop(dim))
            columns = [pa.array([dim], pa.int32()), pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary()), pa.array([_small(np.stack(data)).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["dim", "ids", "data"])

        for b in batches:
            vectors = b.column(1)
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for i, key in enumerate(b.column(0).to_pylist()):
                if key is None:
                    continue
                own = flat[offsets[i] : offsets[i + 1]]
                held.setdefault(len(own), []).append((key, own))
                if len(held[len(own)]) >= rows:
                    yield row(len(own))
        for dim in list(held):
            yield row(dim)

    return run


def _scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products as exact integers, by floating point where that is exact."""
    largest = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    top = largest(queries) * largest(shard) * max(1, queries.shape[1])
    if top < _EXACT_FLOAT:
        return (queries.astype(np.float64) @ shard.astype(np.float64).T).astype(np.int64)
    if top < 2**63:
        return queries.astype(np.int64) @ shard.astype(np.int64).T
    exact = queries.astype(object) @ shard.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of one query, smaller ids first among equals, without its own id."""
    other = ids != own
    scores, ids = scores[other], ids[other]
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        scores, ids = scores[at], ids[at]
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -(2**63) else -scores))[:k]
    return scores[order], ids[order]


def _best(k: int, wave: Broadcast):
    """Keeps for each query of a wave the best of all tiles that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = list(_blocks(wave.value))
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            for at in range(b.num_rows):
                dim, raw, data = (b.column(i)[at].as_py() for i in range(3))
                ids = np.frombuffer(raw, dtype="<i8")
                shard = _matrix(data, len(ids), dim)
                for width, q_ids, queries in blocks:
                    if width != dim:
                        continue
                    scores = _scores(queries, shard)
                    for row, top, own in zip(scores, scores.max(axis=1).tolist(), q_ids.tolist()):
                        held = lists.get(own)
                        if held is not None and len(held[0]) == k and top < held[0][-1]:
                            continue
                        found = select(row, ids, own, k)
                        if held is not None:
                            found = select(*(np.concatenate(x) for x in zip(held, found)), own, k)
                        lists[own] = found
        rows = [(q, s, i) for q, (s, i) in lists.items() if len(s)]
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            n = [len(s) for _, s, _ in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([q for q, _, _ in some], dtype=np.int64), n)), pa.array(np.full(sum(n), part, dtype=np.int32)),
                    pa.array(np.concatenate([i for _, _, i in some])), pa.array(np.concatenate([s for _, s, _ in some])),
                ],
                names=["query_id", "part", "vec_id", "score"],
            )

    return run


def top_k(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """For each query its k rows of `vectors` with the highest integer inner product.

    Both tables have integer vectors, as quantised() makes them.  Returns
    query_id, rank from 1, vec_id and score; equal scores go to the smaller id.
    A row with the query's own id is no candidate, whichever rows repeat it;
    repeated candidate rows are candidates each, and queries that repeat an id
    are answered as one, by the best of their lists.  Only vectors of the
    query's length are candidates.  Rows with a null id take no part.  Scores
    beyond 64 bits are held at the limit.  Empty tables give no rows.  Other
    columns are not read.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("vector"))
    packed = "dim int, ids binary, data binary"
    spark = vectors.sparkSession
    shards = pick(vectors).mapInArrow(_packed(SHARD_ROWS), packed)
    blocks = checkpointed(pick(queries).mapInArrow(_packed(BLOCK_ROWS), packed))
    sizes = blocks.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("ids")).first()
    waves = max(1, -(-sizes["bytes"] // WAVE_BYTES), -(-sizes["ids"] // (8 * WAVE_ROWS)))
    if waves > 1:
        waves *= 2  # blocks are dealt by hash: a wave has half of the bound on average
        shards, out = checkpointed(shards), step_path(spark)
    for wave in range(waves):
        own = blocks.where(F.pmod(F.xxhash64("ids"), F.lit(waves)) == wave) if waves > 1 else blocks
        held = spark.sparkContext.broadcast([(r.dim, bytes(r.ids), bytes(r.data)) for r in own.collect()])
        lists = shards.mapInArrow(_best(k, held), "query_id long, part int, vec_id long, score long")
        lists = _merged(lists, k, ["query_id", F.floor(F.col("part") / FAN_IN).alias("branch")])
        lists = _merged(lists, k, ["query_id"]).select("query_id", "rank", "vec_id", "score")
        if waves == 1:
            return lists
        lists.write.mode("append").parquet(out)
        held.destroy()
    # A query id whose rows lie in blocks of several waves has a list from each.
    return _merged(spark.read.parquet(out).drop("rank"), k, ["query_id"]).select("query_id", "rank", "vec_id", "score")


def _merged(lists: DataFrame, k: int, keys: list) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id"))
    return lists.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
