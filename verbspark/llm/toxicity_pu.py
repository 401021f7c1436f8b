"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the words of a text, and the beginnings of its words, is
trained from texts confirmed as toxic and from unlabelled texts.  Its features
are those that are more frequent in toxic texts, so a text with none of them
has the lowest score.  The risk of
the unlabelled texts, less what the class prior says is due to toxic ones
among them, is kept from becoming negative: a step that would make it so is
taken backwards.

Training uses bounded samples, `positives` and `unlabelled`; every text is
then scored whole in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import checkpointed
from .text_kernels import mix64, words

POSITIVES, UNLABELLED, FEATURES = 1500, 4000, 2048
#: Bytes of a word's beginning that are features besides the whole word.
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
STEPS, RATE, DECAY = 600, 0.05, 1e-3
#: A feature has value 1/2 at this share of the words; texts count as longer by a few words.
HALF_SHARE, FEW_WORDS = 0.01, 20
#: Features must be more frequent in toxic texts by so many standard errors, and occur in so many texts.
LEAST_Z, LEAST_TEXTS = 4.5, 5
_PROBE_BITS = 18


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature its hash for every word, 0 for none, and the words' bounds by text."""
    w = words(column, SEPARATORS, PREFIXES)
    kinds = [w.hashes, *w.prefixes]
    for k, hashes in enumerate(kinds):
        with np.errstate(over="ignore"):
            mixed = mix64(hashes + np.uint64(k))
        mixed[hashes == 0] = 0
        yield mixed, w.bounds


def _parts(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some megabytes of text each."""
    at = 0
    while at < b.num_rows:
        n = 256
        while n > 1 and b.column(column).slice(at, n).nbytes > 2 << 20:
            n //= 2
        yield b.slice(at, n)
        at += n


def densities(column: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of the chosen features that texts have.

    A value grows with the feature's share of the text's words and nears 1.
    """
    bits = np.zeros(1 << _PROBE_BITS, dtype=bool)
    bits[features & np.uint64((1 << _PROBE_BITS) - 1)] = True
    found, size = [], max(1, len(features))
    for hashes, bounds in _features(column):
        at = np.flatnonzero(bits[hashes & np.uint64((1 << _PROBE_BITS) - 1)])
        which = np.searchsorted(features, hashes[at])
        which[which == len(features)] = 0
        real = features[which] == hashes[at] if len(features) else np.zeros(0, dtype=bool)
        text = np.searchsorted(bounds, at[real], side="right") - 1
        found.append(text * size + which[real])
        lengths = np.diff(bounds)
    pairs, counts = np.unique(np.concatenate(found), return_counts=True)
    share = counts / (lengths[pairs // size] + FEW_WORDS)
    return pairs // size, pairs % size, share / (share + HALF_SHARE)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (body, positive, unlabelled) become counts of texts with each feature."""
    for b in batches:
        for part in _parts(b, 0):
            sides = [part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)]
            pairs = []
            for hashes, bounds in _features(part.column(0)):
                text = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                some = hashes != 0
                order = np.lexsort((text[some], hashes[some]))
                h, t = hashes[some][order], text[some][order]
                new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
                pairs.append((h[new], t[new]))
            h, t = (np.concatenate(x) for x in zip(*pairs))
            distinct, which = np.unique(h, return_inverse=True)
            sums = [np.bincount(which, weights=s[t], minlength=len(distinct)).astype(np.int64) for s in sides]
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *map(pa.array, sums)], names=["feature", "p", "u"])


class Rows(NamedTuple):
    """A sparse matrix: what is in each row, and the numbers of rows and columns."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int
    width: int

    def times(self, theta: np.ndarray) -> np.ndarray:
        """The product with all but the last of theta, plus the last."""
        return np.bincount(self.row, weights=self.value * theta[self.column], minlength=self.n) + theta[-1]

    def mean(self, weights: np.ndarray) -> np.ndarray:
        """The rows' mean by weights, each row with a last component of 1."""
        columns = np.bincount(self.column, weights=self.value * weights[self.row], minlength=self.width)
        return np.append(columns, weights.sum()) / self.n


def train(p: Rows, u: Rows, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with the logistic loss."""
    width = p.width
    theta = np.zeros(width + 1)
    theta[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = p.times(theta), u.times(theta)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = u.mean(sigmoid(zu)) - prior * p.mean(sigmoid(zp))
        if negative_risk < 0:
            gradient = -negative
        else:
            gradient = negative - prior * p.mean(1 - sigmoid(zp))
        gradient[:-1] += DECAY * prior * theta[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def learn(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from rows of `docs` and `labels` where `use`, on id_col, holds.

    At most `positives` texts labelled 1 and about `unlabelled` texts, at most
    twice as many, whatever their label, are used, chosen by a hash of id and
    text; rows with equal id and text count once.  `prior` is the share of
    toxic texts; without it, the share among the labels.  Labels that are null,
    or for ids that docs lacks, and rows with a null id are left out; an id
    with several labels is toxic if one is 1.  Of features with equal scores
    those with smaller hashes are taken.  Without any toxic text every score is
    the prior.
    """
    own = labels.where(use & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    share = own.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = min(0.95, max(1e-3, share or 0.0)) if prior is None else prior
    toxic = own.where("toxic = 1").orderBy(F.xxhash64(id_col, F.lit(3)), id_col).limit(positives).select(F.col(id_col).alias("id"))
    rows = docs.where(use & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("place", F.xxhash64("id", "body", F.lit(5)))
    # The draw moves ids and hashes only; then the texts that were drawn are fetched.
    places = checkpointed(rows.select("id", "place"))
    share = int((1 << 30) * min(1.0, unlabelled / max(1, docs.count())))
    some = lambda df, n: df.distinct().orderBy("place", "id").limit(n)
    own = some(places.join(F.broadcast(toxic), "id", "left_semi"), positives).withColumns({"p": F.lit(1), "u": F.lit(0)})
    others = some(places.where(F.pmod("place", F.lit(1 << 30)) < share), 2 * unlabelled).withColumns({"p": F.lit(0), "u": F.lit(1)})
    drawn = checkpointed(own.unionByName(others).groupBy("id", "place").agg(F.max("p").alias("p"), F.max("u").alias("u")))
    sample = rows.join(F.broadcast(drawn), ["id", "place"]).dropDuplicates(["id", "place"]).select("id", "body", "p", "u")
    sample = checkpointed(sample)
    sizes = sample.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("u"), F.lit(0))).first()
    if not sizes[0] or not sizes[1]:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    counts = sample.select("body", "p", "u").mapInArrow(_counting, "feature long, p long, u long")
    counts = counts.groupBy("feature").agg((F.sum("p") / sizes[0]).alias("p"), (F.sum("u") / sizes[1]).alias("u"))
    pooled = (F.col("p") * sizes[0] + F.col("u") * sizes[1]) / sum(sizes)
    z = (F.col("p") - F.col("u")) / F.sqrt(pooled * (1 - pooled) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)
    counts = counts.where(pooled * sum(sizes) >= LEAST_TEXTS - 0.5)
    best = counts.select("feature", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "feature").limit(FEATURES).collect()
    features = np.sort(np.array([r.feature for r in best], dtype=np.int64).view(np.uint64))
    if not len(features):
        return Model(features, np.zeros(0), float(np.log(prior / (1 - prior))))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, 0):
                text, feature, value = densities(part.column(0), features)
                cuts = np.searchsorted(text, np.arange(1, part.num_rows))
                found, values = ([x.tobytes() for x in np.split(y, cuts)] for y in (feature.astype("<u2"), value.astype("<f4")))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.array(found, pa.binary()), pa.array(values, pa.binary())], names=["id", "p", "u", "found", "values"])

    kind = docs.schema[id_col].dataType.simpleString()
    vectors = sample.select("body", "id", "p", "u").mapInArrow(chosen, f"id {kind}, p int, u int, found binary, values binary").collect()
    vectors.sort(key=lambda r: (r.id, bytes(r.found), bytes(r["values"])))
    sides = []
    for side in ("p", "u"):
        found = [(np.frombuffer(r.found, dtype="<u2"), np.frombuffer(r["values"], dtype="<f4")) for r in vectors if r[side]]
        row = np.repeat(np.arange(len(found)), [len(f) for f, _ in found])
        sides.append(Rows(row, np.concatenate([f for f, _ in found]).astype(np.int64), np.concatenate([v for _, v in found]).astype(np.float64), len(found), len(features)))
    weights, bias = train(*sides, prior)
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The probability that each text is toxic: id_col, the columns of `carry`, score.

    A null or empty text has no features and gets the score of the bias alone.
    Null and repeated ids are kept, a row each.  No rows give no rows.  Columns
    that are not named are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys([id_col, *carry]))
    read = list(dict.fromkeys([*names, text_col]))  # a carried text goes to Python once
    text_at = read.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for part in _parts(b, text_at):
                text, feature, values = densities(part.column(text_at), model.features)
                z = np.full(part.num_rows, model.bias)
                if len(feature):
                    z += np.bincount(text, weights=model.weights[feature] * values, minlength=part.num_rows)
                value = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(value)], names=[*(f"c{i}" for i in range(len(names))), "score"])

    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(read)))
    kinds = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(names)))
    out = rows.mapInArrow(run, f"{kinds}, score double")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "score")
