"""Toxicity: held-out quality, the risk estimator, awkward texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verbspark.llm import toxicity_pu as T
from verbspark.llm.queries import QUERIES, fold

DATA = "/root/testdata/sf0.1"


def test_held_out_quality_and_columns(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op9_toxicity_pu"](spark, DATA)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    got = rows.join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.toxic and r.predicted for r in got)
    assert hit >= 0.9 * sum(r.toxic for r in got) and hit >= 0.85 * sum(r.predicted for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, "vile rant" if i % 5 == 0 else "kind words") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(fold(4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.learn(docs, own, fold(4) != 2) for own in (labels, flipped))
    assert (a.features == b.features).all() and (a.weights == b.weights).all() and a.bias == b.bias


def test_non_negative_risk_separates_and_keeps_the_prior():
    rng = np.random.default_rng(1)
    p = np.zeros((60, 5))
    p[:, 0] = 1
    u = np.zeros((400, 5))
    u[:80, 0] = 1
    p[:, 1:] = u[:, 1:][:60] = rng.integers(0, 2, (60, 4))
    rows = lambda x: T.Rows(*np.nonzero(x), x[np.nonzero(x)], *x.shape)
    weights, bias = T.train(rows(p), rows(u), 0.2)
    s = lambda x: 1 / (1 + np.exp(-(x @ weights + bias)))
    assert s(p).min() > 0.5 and s(u[80:]).max() < 0.3


def test_densities_against_plain_counts():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("Idiot", "idiots", "idea", "x", "é")) for _ in range(rng.randint(0, 20))) for _ in range(50)] + [""]
    column = pa.array(texts)
    kinds = list(T._features(pa.array(["idiot"])))
    whole, prefix = kinds[0][0][0], kinds[1 + T.PREFIXES.index(5)][0][0]
    features = np.sort(np.array([whole, prefix], dtype=np.uint64))
    text, feature, value = T.densities(column, features)
    got = {(int(t), int(features[f])): v for t, f, v in zip(text, feature, value)}
    expected = {}
    for i, t in enumerate(texts):
        w = t.lower().split()
        for key, n in ((int(whole), w.count("idiot")), (int(prefix), sum(x.startswith("idiot") for x in w))):
            if n:
                share = n / (len(w) + T.FEW_WORDS)
                expected[i, key] = share / (share + T.HALF_SHARE)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)


def test_edge_cases(spark):
    rows = [(i, ("awful scum here " if i % 4 == 0 else "plain talk today ") * (1 + i % 3)) for i in range(80)] + [(100, None), (101, ""), (None, "scum"), (3, "SCUM! awful"), (102, "scum " * 200000)]
    docs = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, text string, toxic int, body string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(None, 1), (4, 0), (5, None), (999, 1)], "doc_id long, toxic int")
    model = T.learn(docs, labels, F.lit(True))
    got = T.score(docs, model, carry=("body",)).collect()
    assert len(got) == len(rows) and {r.body for r in got} == {"q"}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[100] == by[101] and by[100][0] < 0.3 < by[102][0] and by[None][0] > by[100][0] and max(by[3]) > 0.3
    none = T.learn(docs, labels.limit(0), F.lit(True))
    assert len({r.score for r in T.score(docs, none).collect()}) == 1
    assert T.score(docs.limit(0), model).collect() == []
    assert len(T.learn(docs.limit(0), labels, F.lit(True)).features) == 0


def test_scores_row_by_row(spark):
    """Every score of the table again, with words counted one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = T.learn(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), fold(4) != 2)
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    assert weights
    texts = {r.doc_id: re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode())) for r in docs.collect()}
    kinds = (None, *T.PREFIXES)
    code = {}
    for word in {w for t in texts.values() for w in t}:
        code[word] = [int(h[0]) for h, _ in T._features(pa.array([word], pa.binary()))]
    for r in T.score(docs, model).collect():
        words, z = texts[r.doc_id], model.bias
        for k in range(len(kinds)):
            for h, n in Counter(code[w][k] for w in words).items():
                if h in weights:
                    share = n / (len(words) + T.FEW_WORDS)
                    z += weights[h] * share / (share + T.HALF_SHARE)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_the_sample_is_bounded_for_repeated_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "checkpointed", lambda df, real=T.checkpointed: seen.append(real(df)) or seen[-1])
    docs = spark.range(3000).selectExpr("id % 2 AS doc_id", "concat('awful scum ', id % 1500) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    T.learn(docs, labels, F.lit(True), positives=20, unlabelled=50)
    counts = seen[-1].agg(F.sum("p"), F.sum("u")).first()
    assert counts[0] == 20 and 20 < counts[1] <= 100
