"""Language identification by nearest centroid.

A text is a vector of hashed three-byte grams of its letters: counts are
damped, weighted by inverse document frequency and normalised.  Each language
has a few centroids, found by clustering its sample on the sphere, and a text
gets the language of the centroid with the highest cosine.  A cosine below
what the language's own sample shows marks the text as rejected.

The model is fitted on a bounded sample of labelled rows (`per_language`), and
every text is then read whole in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text_kernels import text_buffer

BITS = 13
GRAMS = 1 << BITS
PER_LANGUAGE, CLUSTERS, ROUNDS = 600, 3, 12
#: Share of a language's own sample that lies below its rejection threshold.
REJECTED = 0.002
_BLOCK = 1 << 20


def _folded() -> np.ndarray:
    """A-Z become a-z, other ASCII is one separator, bytes beyond ASCII stay."""
    table = np.full(256, 0x20, dtype=np.uint32)
    table[0x80:] = np.arange(0x80, 0x100)
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c
    return table


_TABLE = _folded()


def gram_counts(column: pa.Array) -> np.ndarray:
    """A row of gram counts for each text; a gram's middle byte is no separator."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    counts = np.zeros(n * GRAMS, dtype=np.float32)
    for begin in range(0, len(data), _BLOCK):
        end = min(len(data), begin + _BLOCK)
        part = _TABLE[data[max(0, begin - 1) : end + 1]]
        if begin == 0:
            part = np.concatenate(([np.uint32(0x20)], part))
        if end == len(data):
            part = np.concatenate((part, [np.uint32(0x20)]))
        before, middle, after = part[:-2].copy(), part[1:-1], part[2:].copy()
        lo, hi = np.searchsorted(offsets, (begin, end))
        first = offsets[lo:hi] - begin  # a text's neighbours are separators
        before[first] = 0x20
        last = offsets[np.searchsorted(offsets, begin, side="right") : np.searchsorted(offsets, end, side="right")] - begin - 1
        after[last] = 0x20
        at = np.flatnonzero(middle != 0x20)
        gram = ((before[at] << 16 | middle[at] << 8 | after[at]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        text = np.searchsorted(offsets, at + begin, side="right") - 1
        some = text.min() if len(text) else 0
        found = np.bincount((text - some) * GRAMS + gram.astype(np.int64))
        counts[some * GRAMS : some * GRAMS + len(found)] += found
    return counts.reshape(n, GRAMS)


def has_letter(column: pa.Array) -> np.ndarray:
    """Which texts hold a letter of any script."""
    data, offsets = text_buffer(column)
    kind = np.zeros(256, dtype=np.int8)
    kind[[*range(65, 91), *range(97, 123)]] = 1
    marks = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
    out = marks[offsets[1:]] > marks[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Model(NamedTuple):
    weights: np.ndarray  # inverse document frequencies
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    least: np.ndarray  # rejection threshold of each centroid's language

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.weights
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _clustered(v: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit vectors: the first seeds are the mean and then what is farthest from all."""
    seeds = [v.mean(axis=0)]
    for _ in range(min(k, len(v)) - 1):
        near = np.max(np.stack([v @ (s / max(np.linalg.norm(s), 1e-12)) for s in seeds]), axis=0)
        seeds.append(v[int(np.argmin(near))])
    c = np.stack(seeds)
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(counts: np.ndarray, languages: list[str], clusters: int = CLUSTERS) -> Model:
    """Fits centroids to gram counts of labelled texts."""
    seen = (counts > 0).sum(axis=0)
    weights = (np.log((1 + len(counts)) / (1 + seen)) + 1).astype(np.float32)
    model = Model(weights, np.zeros((0, GRAMS), dtype=np.float32), [], np.zeros(0))
    centroids, names, least = [], [], []
    labels = np.array(languages, dtype=object)
    for language in sorted(set(languages)):
        v = model.vectors(counts[labels == language])
        c = _clustered(v, clusters).astype(np.float32)
        low = float(np.quantile(np.max(v @ c.T, axis=1), REJECTED)) * 0.9
        centroids.append(c)
        names += [language] * len(c)
        least += [low] * len(c)
    if not names:
        return model
    return model._replace(centroids=np.concatenate(centroids), languages=names, least=np.array(least))


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most 64 rows; the gram matrix of one takes 2 MB."""
    for at in range(0, b.num_rows, 64):
        yield b.slice(at, 64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in _parts(b):
            counts = gram_counts(part.column(1))
            rows = [np.flatnonzero(r) for r in counts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([at.astype("<u2").tobytes() for at in rows], pa.binary()), pa.array([r[at].astype("<f4").tobytes() for r, at in zip(counts, rows)], pa.binary())],
                names=["lang", "grams", "counts"],
            )


def learn(docs: DataFrame, use: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from a sample of about `per_language` rows of each language, out of those where `use` holds.

    Rows with a null language or a text without letters teach nothing.  The
    sample is chosen by a hash of the text, so it is the same in every run;
    equal texts count once, and no language has more than twice as many.
    """
    rows = docs.where(use & F.col(lang_col).isNotNull())
    totals = rows.groupBy(F.col(lang_col).alias("lang")).count().collect()
    if not totals:
        return fit(np.zeros((0, GRAMS), dtype=np.float32), [])
    share = F.create_map(*(x for r in totals for x in (F.lit(r["lang"]), F.lit(per_language / r["count"]))))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("body"), F.xxhash64(F.col(text_col), F.lit(11)).alias("place"))
    chosen = rows.where(F.pmod("place", F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")]).dropDuplicates(["lang", "place"])
    first = Window.partitionBy("lang").orderBy("place")  # as many rows as are wanted, or twice as many if the hash is against us
    chosen = chosen.withColumn("n", F.row_number().over(first)).where(F.col("n") <= 2 * per_language).select("lang", "body")
    sample = chosen.mapInArrow(_sampled, "lang string, grams binary, counts binary").collect()
    sample = sorted((r for r in sample if len(r.grams)), key=lambda r: (r.lang, bytes(r.grams), bytes(r.counts)))
    counts = np.zeros((len(sample), GRAMS), dtype=np.float32)
    for row, r in zip(counts, sample):
        row[np.frombuffer(r.grams, dtype="<u2")] = np.frombuffer(r.counts, dtype="<f4")
    return fit(counts, [r.lang for r in sample])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every text: id_col, lang_pred, score (the cosine, 0 to 1), rejected.

    A null text, or one without a letter, is `und` with score 0 and rejected.
    Any other text gets the nearest learned language, of equally near ones the
    first by name; `rejected` tells that it is farther from it than the
    language's own texts.  A model without
    languages calls everything `und`.  Null and repeated ids are kept, a row
    each.  No rows give no rows.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for part in _parts(b):
                letters = has_letter(part.column(1))
                names, score = ["und"] * len(letters), np.zeros(len(letters))
                rejected = np.ones(len(letters), dtype=bool)
                if model.languages:
                    cosine = model.vectors(gram_counts(part.column(1))) @ model.centroids.T
                    best = np.argmax(cosine, axis=1)
                    top = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
                    names = [model.languages[k] if ok else "und" for k, ok in zip(best, letters)]
                    score = np.where(letters, top, 0.0)
                    rejected = ~letters | (top < model.least[best])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
