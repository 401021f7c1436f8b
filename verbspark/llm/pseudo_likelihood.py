"""Language-model scores by masked pseudo-likelihood.

Every token of a text is predicted from the tokens on both its sides, itself
masked, by a small window network; the summed conditional log-probabilities
score the text.

Tokens are words; the most frequent words of the whole corpus have an id each
in the network and the others share hashed ids.  The network adds the
embeddings of the neighbours, weighted by place, and predicts first the class
of the token and then the token within its class, which costs the square root
of a full softmax.  A word that shares its id is then predicted among the words
of that id, by their counts over the whole corpus.  The table of counts grows
with the corpus; it is joined to the tokens and never sent anywhere whole.

Training reads every token of the corpus once, in ROUNDS.  Texts are dealt by
hash to rounds and shards; their number follows from the corpus, not from its
partitions.  In a round each shard trains a copy of the model on its tokens, in
the order of the hashes, and the copies are averaged by their tokens, block of
parameters by block, in a shuffle; the next round starts from the average.  So
equal tables give equal models however they are partitioned.  Only the averaged
model, of fixed size, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed
from .text_kernels import words

SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
#: Classes, tokens of a class, hashed ids for other words, and places on each side.
CLASSES, MEMBERS, HASHED, SIDE = 64, 64, 256, 2
VOCABULARY = CLASSES * MEMBERS
WIDTH, BATCH, RATE = 16, 8192, 0.05
#: Averaging rounds; tokens of a shard over all rounds, unless that makes too many shards.
ROUNDS, SHARD_TOKENS, MOST_SHARDS = 4, 2_000_000, 16_384
#: Tokens that are mixed before they are dealt into batches.
MIXED = 32 * BATCH
#: Distinct words that a task counts before it passes them on.
COUNTED = 1_000_000
_BLOCK = 2048
_UNIT = 2.0**32
_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
_SHAPES = {
    "embedding": (VOCABULARY + 1, WIDTH), "place": (len(_OFFSETS), WIDTH), "bias": (WIDTH,), "class_out": (CLASSES, WIDTH), "class_bias": (CLASSES,),
    "member_out": (CLASSES, MEMBERS, WIDTH), "member_bias": (CLASSES, MEMBERS),
}
#: Step sizes: one for each row of parameters.
_SQUARES = {name: shape[:-1] if len(shape) > 1 else shape for name, shape in _SHAPES.items()}

Parameters = dict[str, np.ndarray]


class Vocabulary:
    """Ids of words by their hash: frequent ones in order of frequency, then the hashed rest.

    `rest` has the number of tokens of each hashed id, `table` the counts
    (word, n) of all words; without it, no word is without an id of its own.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, rest: np.ndarray | None = None, table: DataFrame | None = None):
        self.total = int(total)
        self.rest = np.zeros(HASHED) if rest is None else rest
        self.table = table
        order = np.argsort(hashes, kind="stable")
        self._hashes, self._ids = hashes[order], order
        own = np.full(VOCABULARY, max(1.0, (total - counts.sum()) / HASHED))
        own[: VOCABULARY - HASHED] = 0.5
        own[: len(counts)] = counts
        self.weights = own

    def __getstate__(self) -> dict:
        return {**self.__dict__, "table": None}  # executors have no use for a DataFrame

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = (VOCABULARY - HASHED + (hashes % np.uint64(HASHED)).astype(np.int64)).astype(np.int32)
        if len(self._hashes):
            at = np.searchsorted(self._hashes, hashes)
            at[at == len(self._hashes)] = 0
            known = self._hashes[at] == hashes
            out[known] = self._ids[at[known]]
        return out


def start(weights: np.ndarray) -> Parameters:
    """Parameters before training: no context, and the words' own frequencies as biases."""
    rng = np.random.default_rng(20)
    out = {name: np.zeros(shape, dtype=np.float32) for name, shape in _SHAPES.items()}
    out["embedding"][:] = rng.normal(0, 0.1, _SHAPES["embedding"])
    out["place"][:] = 1.0
    out["class_out"][:] = rng.normal(0, 0.1, _SHAPES["class_out"])
    out["member_out"][:] = rng.normal(0, 0.1, _SHAPES["member_out"])
    by_class = weights.reshape(CLASSES, MEMBERS)
    out["class_bias"][:] = np.log(by_class.sum(axis=1) / weights.sum())
    out["member_bias"][:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    return out


def flat(p: Parameters, shapes: dict[str, tuple[int, ...]] = _SHAPES) -> np.ndarray:
    return np.concatenate([p[name].ravel() for name in shapes])


def shaped(values: np.ndarray, shapes: dict[str, tuple[int, ...]] = _SHAPES) -> Parameters:
    out, at = {}, 0
    for name, shape in shapes.items():
        n = int(np.prod(shape))
        out[name] = np.array(values[at : at + n], dtype=np.float32).reshape(shape)
        at += n
    return out


def contexts(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each token its neighbours' ids; VOCABULARY stands for a place outside the text."""
    n = len(ids)
    lengths = np.diff(bounds)
    begin, end = np.repeat(bounds[:-1], lengths), np.repeat(bounds[1:], lengths)
    out = np.full((n, len(_OFFSETS)), VOCABULARY, dtype=np.int32)
    for k, offset in enumerate(_OFFSETS):
        at = np.arange(n) + offset
        inside = (at >= begin) & (at < end)
        out[inside, k] = ids[at[inside]]
    return out


def _exponentials(h: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and the sums of those."""
    logits = h @ out.T
    logits += bias
    np.minimum(logits, 80, out=logits)
    e = np.exp(logits)
    return logits, e, e @ np.ones(len(bias), dtype=np.float32)


def _hidden(p: Parameters, near: np.ndarray) -> np.ndarray:
    total = np.take(p["embedding"], near[:, 0], axis=0)
    total *= p["place"][0]
    for k in range(1, near.shape[1]):
        more = np.take(p["embedding"], near[:, k], axis=0)
        more *= p["place"][k]
        total += more
    total += p["bias"]
    return np.tanh(total, out=total)


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts tokens of a class together, and (class, begin, end) of the classes in it."""
    classes = ids // MEMBERS
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(classes[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, cuts[c], cuts[c + 1]) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]


def log_probabilities(p: Parameters, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The log-probability of each token given its neighbours."""
    out = np.empty(len(ids))
    for begin in range(0, len(ids), BATCH):
        order, classes = _by_class(ids[begin : begin + BATCH])
        order += begin
        own = ids[order]
        h = _hidden(p, context[order])
        rows, member = np.arange(len(own)), own % MEMBERS
        logits, _, sums = _exponentials(h, p["class_out"], p["class_bias"])
        logp = logits[rows, own // MEMBERS] - np.log(sums)
        for c, a, b in classes:
            logits, _, sums = _exponentials(h[a:b], p["member_out"][c], p["member_bias"][c])
            logp[a:b] += logits[rows[: b - a], member[a:b]] - np.log(sums)
        out[order] = logp
    return out


class Trainer:
    """Stochastic gradient steps with a step size per row of parameters."""

    def __init__(self, p: Parameters, squares: Parameters | None = None):
        self.p = p
        self.squares = squares or {name: np.full(shape, 1e-6, dtype=np.float32) for name, shape in _SQUARES.items()}
        self.tokens = 0

    def _move(self, name: str, at, gradient: np.ndarray) -> None:
        seen = self.squares[name]
        if gradient.ndim > 1:
            seen[at] += np.einsum("...i,...i->...", gradient, gradient) / np.float32(gradient.shape[-1])
            self.p[name][at] -= RATE * gradient / np.sqrt(seen[at])[..., None]
        else:
            seen[at] += gradient**2
            self.p[name][at] -= RATE * gradient / np.sqrt(seen[at])

    def step(self, ids: np.ndarray, near: np.ndarray) -> None:
        p, n = self.p, len(ids)
        order, classes = _by_class(ids)
        ids, near = ids[order], near[order]
        h = _hidden(p, near)
        rows, member = np.arange(n), ids % MEMBERS
        ones = np.ones(n, dtype=np.float32)
        whole = slice(None)

        def errors(own: np.ndarray, out: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
            _, e, sums = _exponentials(own, out, bias)
            e /= sums[:, None]
            e[rows[: len(own)], target] -= 1
            return e

        d = errors(h, p["class_out"], p["class_bias"], ids // MEMBERS)
        dh = d @ p["class_out"]
        member_out, member_bias = np.zeros(_SHAPES["member_out"], dtype=np.float32), np.zeros((CLASSES, MEMBERS), dtype=np.float32)
        for c, a, b in classes:
            q = errors(h[a:b], p["member_out"][c], p["member_bias"][c], member[a:b])
            dh[a:b] += q @ p["member_out"][c]
            np.matmul(q.T, h[a:b], out=member_out[c])
            np.matmul(ones[a:b], q, out=member_bias[c])
        self._move("class_out", whole, d.T @ h / n)
        self._move("class_bias", whole, ones @ d / n)
        self._move("member_out", whole, member_out / n)
        self._move("member_bias", whole, member_bias / n)
        dh *= 1 - h * h
        dh /= n
        seen = near.T.astype(np.uint16).ravel()  # place by place
        order = np.argsort(seen, kind="stable")
        sorted_ids = seen[order]
        first = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
        gradient = np.empty((len(_OFFSETS), n, WIDTH), dtype=np.float32)
        moves = np.empty((len(_OFFSETS), WIDTH), dtype=np.float32)
        for k in range(len(_OFFSETS)):
            np.multiply(dh, p["place"][k], out=gradient[k])
            moves[k] = np.einsum("ij,ij->j", np.take(p["embedding"], near[:, k], axis=0), dh)
        sums = np.add.reduceat(np.take(gradient.reshape(-1, WIDTH), order, axis=0), first, axis=0)
        self._move("place", whole, moves)
        self._move("bias", whole, dh.sum(axis=0))
        self._move("embedding", sorted_ids[first], sums)
        self.tokens += n


def _parts(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some megabytes of text each."""
    at = 0
    while at < b.num_rows:
        n = 512
        while n > 1 and b.column(column).slice(at, n).nbytes > 2 << 20:
            n //= 2
        yield b.slice(at, n)
        at += n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) for the words of a task; the null word stands for all of them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        which, distinct = pd.factorize(np.concatenate([h for h, _ in held]))
        return distinct, np.bincount(which, weights=np.concatenate([c for _, c in held])).astype(np.int64)

    def batch() -> pa.RecordBatch:
        distinct, counts = merged()
        named = pa.array(np.append(distinct.view(np.int64), 0), mask=np.append(np.zeros(len(distinct), dtype=bool), True))
        return pa.RecordBatch.from_arrays([named, pa.array(np.append(counts, counts.sum()))], names=["word", "n"])

    for b in batches:
        for part in _parts(b, 0):
            hashes = words(part.column(0), SEPARATORS).hashes
            held.append((hashes, np.ones(len(hashes))))
            size += len(hashes)
            if size > COUNTED:
                held = [merged()]
                size = len(held[0][0])
                if size > COUNTED // 2:
                    yield batch()
                    held, size = [], 0
    if size:
        yield batch()


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """All words of all texts, the most frequent with an id each; equal counts go by hash."""
    counts = checkpointed(docs.select(F.col(text_col).alias("body")).mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    ranked = counts.orderBy(F.col("n").desc(), "word").limit(VOCABULARY - HASHED + 1).collect()
    total = sum(r.n for r in ranked if r.word is None)
    ranked = [r for r in ranked if r.word is not None]
    hashes, numbers = np.array([r.word for r in ranked], dtype=np.int64).view(np.uint64), np.array([r.n for r in ranked], dtype=np.float64)
    if total <= numbers.sum():
        return Vocabulary(hashes, numbers, total)
    rest = -np.bincount((hashes % np.uint64(HASHED)).astype(np.int64), weights=numbers, minlength=HASHED)
    counts = counts.where("word is not null")
    for r in counts.groupBy(F.pmod("word", F.lit(HASHED)).alias("id")).agg(F.sum("n").alias("n")).collect():
        rest[r.id] += r.n
    return Vocabulary(hashes, numbers, total, rest, counts)


class Mixer:
    """Trains on the texts of one shard, mixed some at a time, however they are cut into batches of rows."""

    def __init__(self, trainer: Trainer):
        self.trainer = trainer
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        near = contexts(ids, bounds)
        at = 0
        while at < len(ids):
            end = min(len(ids), at + MIXED - self._size)
            self._held.append((ids[at:end], near[at:end]))
            self._size += end - at
            at = end
            if self._size >= MIXED:
                self.flush()

    def flush(self) -> None:
        if self._size:
            ids, near = (np.concatenate(x) for x in zip(*self._held))
            mixed = np.random.default_rng(len(ids)).permutation(len(ids))
            for a in range(0, len(ids), BATCH):
                at = mixed[a : a + BATCH]
                self.trainer.step(ids[at], near[at])
        self._held, self._size = [], 0


def train(docs: DataFrame, words_known: Vocabulary, text_col: str = "text", id_col: str = "doc_id") -> Parameters:
    """Parameters trained on all tokens of all texts, once each.

    Texts are dealt by a hash of id and text, so that copies of a text do not
    all meet in one shard.  No texts give the parameters before training.
    """
    shards = int(max(1, min(MOST_SHARDS, -(-words_known.total // SHARD_TOKENS))))
    rows = docs.select(F.col(text_col).alias("body"), F.xxhash64(F.lit(31), F.col(id_col), F.col(text_col)).alias("place")).where("body is not null")
    rows = rows.withColumn("shard", F.pmod(F.shiftright("place", 8), F.lit(shards)).cast("int"))
    parameters, squares = start(words_known.weights), Trainer({}).squares
    for turn in range(ROUNDS):
        own = rows.where(F.pmod("place", F.lit(ROUNDS)) == turn)
        own = own.repartition(shards, "shard").sortWithinPartitions("shard", "place").select("shard", "body")
        state = _averaged(own, words_known, parameters, squares)
        if state is not None:
            parameters, squares = state
    return parameters


def _averaged(rows: DataFrame, words_known: Vocabulary, parameters: Parameters, squares: Parameters) -> tuple[Parameters, Parameters] | None:
    """The mean of the models that each shard trains from the given one; None without tokens."""
    shared = rows.sparkSession.sparkContext.broadcast((words_known, parameters, squares))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parameters, squares = shared.value
        now, mixer = None, None

        def done() -> Iterator[pa.RecordBatch]:
            mixer.flush()
            trainer = mixer.trainer
            if trainer.tokens:
                values = np.concatenate((flat(trainer.p), flat(trainer.squares, _SQUARES)))
                blocks = [values[a : a + _BLOCK].astype("<f4").tobytes() for a in range(0, len(values), _BLOCK)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int32()), pa.array([now] * n, pa.int32()), pa.array([trainer.tokens] * n, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "shard", "tokens", "data"]
                )

        for b in batches:
            of = b.column(0).to_numpy()
            for shard in np.unique(of).tolist():  # rows come by shard
                if shard != now:
                    if mixer:
                        yield from done()
                    now, mixer = shard, Mixer(Trainer({k: v.copy() for k, v in parameters.items()}, {k: v.copy() for k, v in squares.items()}))
                first, last = np.searchsorted(of, (shard, shard + 1)).tolist()
                for part in _parts(b.slice(first, last - first), 1):
                    w = words(part.column(1), SEPARATORS)
                    mixer.add(known.ids(w.hashes), w.bounds)
        if mixer:
            yield from done()

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        weights: dict[int, int] = {}
        for b in batches:
            for block, tokens, data in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                sums[block] = sums.get(block, 0) + tokens * np.frombuffer(data, dtype="<f4").astype(np.float64)
                weights[block] = weights.get(block, 0) + tokens
        if sums:
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([(sums[k] / weights[k]).astype("<f4").tobytes() for k in keys], pa.binary())], names=["block", "data"])

    copies = rows.mapInArrow(local, "block int, shard int, tokens long, data binary")
    copies = copies.repartition("block").sortWithinPartitions("block", "shard")  # sums in one order
    means = sorted(copies.mapInArrow(averaged, "block int, data binary").collect(), key=lambda r: r.block)
    if not means:
        return None
    values = np.concatenate([np.frombuffer(r.data, dtype="<f4") for r in means])
    n = len(flat(parameters))
    return shaped(values[:n]), shaped(values[n:], _SQUARES)


def score(docs: DataFrame, words_known: Vocabulary, parameters: Parameters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's pseudo-log-likelihood: id_col, n_tokens, log_likelihood, per_token.

    A null or empty text has no tokens, log_likelihood 0 and a null per_token.
    Null and repeated ids are kept, a row each.  No rows give no rows.  Other
    columns are not read.  A word that was not counted has half a count.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words_known, parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, p = shared.value
        for b in batches:
            for part in _parts(b, 1):
                w = words(part.column(1), SEPARATORS)
                ids = known.ids(w.hashes)
                logp = log_probabilities(p, ids, contexts(ids, w.bounds))
                hashed = ids >= VOCABULARY - HASHED
                logp[hashed] -= np.log(known.rest[ids[hashed] - (VOCABULARY - HASHED)] + 0.5)
                logp = np.concatenate(([0.0], np.cumsum(logp)))
                total, n = logp[w.bounds[1:]] - logp[w.bounds[:-1]], np.diff(w.bounds)
                cuts = np.concatenate(([0], np.cumsum(hashed)))[w.bounds]
                rest = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(w.hashes[hashed].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(total), rest], names=["id", "n_tokens", "log_likelihood", "rest"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, n_tokens long, log_likelihood double, rest array<long>")
    if words_known.table is None:
        within = F.size("rest") * F.log(F.lit(0.5))
    else:
        out = checkpointed(out.withColumn("row", F.monotonically_increasing_id()))
        words_of = out.select("row", F.explode("rest").alias("word")).join(words_known.table, "word", "left")
        part = F.round(F.log(F.coalesce("n", F.lit(0.5))) * _UNIT).cast("long")  # whole numbers: any order gives the same sum
        out = out.drop("rest").join(words_of.groupBy("row").agg(F.sum(part).alias("within")), "row", "left")
        within = F.coalesce("within", F.lit(0)) / _UNIT
    out = out.select("id", "n_tokens", F.least(F.col("log_likelihood") + within, F.lit(0.0)).alias("log_likelihood"))
    each = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", each.alias("per_token"))


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts words, trains and scores on the same texts."""
    known = vocabulary(docs, text_col)
    return score(docs, known, train(docs, known, text_col, id_col), id_col, text_col)
