"""Pseudo-likelihood scores: arithmetic, gradients, what training learns, awkward texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verbspark.llm import pseudo_likelihood as M
from verbspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def small(seed=1):
    rng = np.random.default_rng(seed)
    return {name: rng.normal(0, 0.3, shape).astype(np.float32) for name, shape in M._SHAPES.items()}


def plain_log_probability(p, token, near):
    z = p["bias"].astype(float).copy()
    for k, n in enumerate(near):
        z += p["embedding"][n].astype(float) * p["place"][k]
    h = np.tanh(z)
    c, m = divmod(int(token), M.MEMBERS)
    total = 0.0
    for out, bias, target in ((p["class_out"], p["class_bias"], c), (p["member_out"][c], p["member_bias"][c], m)):
        logits = out.astype(float) @ h + bias
        total += logits[target] - math.log(np.exp(logits).sum())
    return total


def test_log_probabilities_against_plain_arithmetic():
    p, rng = small(), np.random.default_rng(2)
    ids = rng.integers(0, M.VOCABULARY, 40).astype(np.int32)
    near = M.contexts(ids, np.array([0, 0, 13, 14, 40]))
    assert near[0].tolist() == [M.VOCABULARY, M.VOCABULARY, ids[1], ids[2]] and near[13].tolist() == [M.VOCABULARY] * 4
    got = M.log_probabilities(p, ids, near)
    assert got == pytest.approx([plain_log_probability(p, t, n) for t, n in zip(ids, near)], abs=1e-3)


def test_steps_lower_the_loss_and_blocks_are_whole():
    p, rng = small(3), np.random.default_rng(4)
    ids = rng.integers(0, 50, 4000).astype(np.int32)
    near = M.contexts(ids, np.array([0, 4000]))
    before = M.log_probabilities(p, ids, near).mean()
    trainer = M.Trainer(p)
    for _ in range(20):
        trainer.step(ids, near)
    assert M.log_probabilities(p, ids, near).mean() > before + 1
    again = M.shaped(M.flat(p))
    assert all((again[name] == p[name]).all() for name in p)


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 300, 60).astype(np.int32)
    near = M.contexts(ids, np.array([0, 25, 60]))
    trainer = M.Trainer(small(5))
    trainer.step(ids, near)
    loss = lambda p: -sum(plain_log_probability(p, t, n) for t, n in zip(ids, near)) / len(ids)
    c, m = divmod(int(ids[3]), M.MEMBERS)
    for name, at in (("bias", (2,)), ("class_bias", (c,)), ("class_out", (c, 4)), ("member_out", (c, m, 7)), ("member_bias", (c, m)), ("place", (1, 3)), ("embedding", (int(ids[4]), 5)), ("embedding", (M.VOCABULARY, 1))):
        values = []
        for change in (1e-3, -1e-3):
            p = {k: v.astype(float) for k, v in small(5).items()}
            p[name][at] += change
            values.append(loss(p))
        gradient = (values[0] - values[1]) / 2e-3
        row = at if name in ("bias", "class_bias") else at[:-1]
        moved = trainer.p[name][at] - small(5)[name][at]
        assert moved == pytest.approx(-M.RATE * gradient / math.sqrt(trainer.squares[name][row]), rel=0.02, abs=1e-5)


def test_equal_tables_give_equal_scores_in_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_TOKENS", 40_000)
    monkeypatch.setattr(M, "MIXED", 5_000)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(600)
    few, many = ({r.doc_id: r.log_likelihood for r in M.fit_and_score(docs.repartition(n)).collect()} for n in (4, 40))
    assert few.keys() == many.keys()
    assert [few[k] for k in few] == pytest.approx([many[k] for k in few], rel=1e-5)


def test_scores_of_a_small_table_by_plain_arithmetic(spark, monkeypatch):
    """The query's rows again: words split, counted and scored one by one with the trained parameters."""
    monkeypatch.setattr(M, "SHARD_TOKENS", 300)
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.002)), 6000)}" for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(1000 + i, f"u{i} u{i + 1}") for i in range(2500)] + [(5000, None), (5001, "W1, w2?")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_tokens, r.log_likelihood) for r in M.fit_and_score(df).collect()}

    texts = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in rows}
    names = sorted({w for t in texts.values() for w in t})
    code = dict(zip(names, M.words(pa.array(names), M.SEPARATORS).hashes.tolist()))
    count = Counter(code[w] for t in texts.values() for w in t)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    own = M.VOCABULARY - M.HASHED
    assert len(count) > own
    ids = {h: k if k < own else own + h % M.HASHED for k, h in enumerate(sorted(count, key=lambda h: (-count[h], signed(h))))}
    rest = Counter()
    for h, k in ids.items():
        rest[k] += count[h] if k >= own else 0
    p = M.train(df, M.vocabulary(df))
    for i in [5000, 5001, *range(0, 400, 40), *range(1000, 3500, 250)]:
        seen = [ids[code[w]] for w in texts[i]]
        padded = [M.VOCABULARY] * M.SIDE + seen + [M.VOCABULARY] * M.SIDE
        total = 0.0
        for k, (w, token) in enumerate(zip(texts[i], seen)):
            total += plain_log_probability(p, token, [padded[k + M.SIDE + d] for d in M._OFFSETS])
            if token >= own:
                total += math.log(count[code[w]] / (rest[token] + 0.5))
        assert got[i] == (len(seen), pytest.approx(min(total, 0.0), rel=1e-4, abs=1e-3))


def test_both_sides_are_used(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):  # the middle word is determined by the words on both its sides
        a, b = rng.randint(0, 7), rng.randint(0, 7)
        rows.append((i, f"l{a} l{a} m{a}x{b} r{b} r{b}"))
    df = spark.createDataFrame(rows * 30, "doc_id long, text string").repartition(2)
    known = M.vocabulary(df)
    p = M.train(df, known)
    probe = spark.createDataFrame([(1, "l1 l1 m1x2 r2 r2"), (2, "l1 l1 m3x2 r2 r2"), (3, "l1 l1 m1x4 r2 r2")], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in M.score(probe, known, p).collect()}
    assert got[1] > got[2] + 0.2 and got[1] > got[3] + 0.2


def test_query_and_training_gain(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op3_pseudo_likelihood"](spark, DATA).collect()}
    assert len(got) == docs.count()
    known = M.vocabulary(docs)
    base = {r.doc_id: r.log_likelihood for r in M.score(docs, known, M.start(known.weights)).collect()}
    tokens = sum(r.n_tokens for r in got.values())
    assert sum(r.log_likelihood for r in got.values()) / tokens > sum(base.values()) / tokens + 0.1
    assert all(r.log_likelihood <= 0 and (r.per_token is None) == (r.n_tokens == 0) for r in got.values())


def test_vocabulary_counts(spark):
    df = spark.createDataFrame([("b a B",), ("c! a",), (None,), ("",)], "text string")
    known = M.vocabulary(df)
    assert len(known._hashes) == 3 and sorted(known.weights[:3]) == [1, 2, 2]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "one"), (None, "two words"), (3, "x " * 200000), (4, "?!")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_tokens int, id string")
    got = sorted(((r.doc_id, r.n_tokens) for r in M.fit_and_score(df).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (3, 1), (None, 2), (3, 200000), (4, 0)], key=str)
    assert M.fit_and_score(df.limit(0)).collect() == []
    nothing = M.fit_and_score(df.where("doc_id < 3")).withColumn("ok", F.col("log_likelihood") == 0).collect()
    assert [r.per_token for r in nothing] == [None, None] and all(r.ok for r in nothing)


def test_every_counted_word_has_a_probability_of_its_own(spark):
    own = M.VOCABULARY - M.HASHED
    frequent = [(i, f"f{i} " * 9) for i in range(own)]
    rare = [(own + i, f"r{i} " * (1 + i % 3)) for i in range(900)]
    df = spark.createDataFrame(frequent + rare, "doc_id long, text string").repartition(3)
    known = M.vocabulary(df)
    p = M.start(known.weights)
    probe = spark.createDataFrame([(f"r{i}", f"r{i}") for i in range(900)] + [("new", "neverseen")], "doc_id string, text string")
    got = {r.doc_id: r.log_likelihood for r in M.score(probe, known, p).collect()}
    names = [f"r{i}" for i in range(900)] + ["neverseen"]
    hashes = M.words(pa.array(names), M.SEPARATORS).hashes
    ids = known.ids(hashes)
    counts = np.array([1 + i % 3 for i in range(900)] + [0.5])
    tokens = np.bincount(ids[:900] - own, weights=counts[:900], minlength=M.HASHED)
    network = M.log_probabilities(p, ids, M.contexts(ids, np.arange(len(ids) + 1)))
    expected = network + np.log(counts / (tokens[ids - own] + 0.5))
    assert [got[n] for n in [*names[:900], "new"]] == pytest.approx(expected.tolist(), abs=1e-6)
