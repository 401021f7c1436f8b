"""Exact top-k against SQL and against plain integer arithmetic."""

import math
import random

import numpy as np
import pytest

from verbspark.llm import exact_topk as K
from verbspark.llm.queries import ORACLE_SQL, QUERIES


def test_query_against_sql(same_rows):
    same_rows("op4_exact_topk", QUERIES, ORACLE_SQL)


def brute(rows, every, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("wave", [1 << 20, 64])
def test_ties_nulls_and_waves(spark, monkeypatch, wave):
    monkeypatch.setattr(K, "SHARD_ROWS", 7)
    monkeypatch.setattr(K, "BLOCK_ROWS", 3)
    monkeypatch.setattr(K, "WAVE_BYTES", wave)
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.5, 0.0, 0.25, 1.0)) for _ in range(3)]) for i in range(60)]
    rows += [(i, [1.0, 1.0, 1.0]) for i in range(60, 90)]
    rows += [(100, None), (105, [1.0, None, 2.0]), (110, [1.0, float("nan"), 2.0]), (115, [float("inf"), 1.0, 1.0]), (120, [1.0, 2.0]), (121, [3.0, 2.0]), (None, [1.0, 1.0, 1.0]), (125, [1e9, 1e9, 1e9]), (126, [-1e9, 1e9, 1e9])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, v array<double>, rank int, id string").repartition(5)
    q = K.quantised(df, "v", 1024)
    got = sorted(tuple(r) for r in K.top_k(q.where("vec_id % 5 = 0"), q, "vec_id", "v", 10).collect())
    assert [g[:3] for g in got] == [e[:3] for e in brute(rows, 5, 10)]
    limit = 2**63
    assert [g[3] for g in got] == [max(-limit, min(limit - 1, e[3])) for e in brute(rows, 5, 10)]


def test_empty_and_fewer_than_k(spark):
    none = spark.createDataFrame([], "vec_id long, v array<float>")
    q = K.quantised(none, "v", 1024)
    assert K.top_k(q, q, "vec_id", "v", 3).collect() == []
    one = K.quantised(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, v array<float>"), "v", 1024)
    assert [tuple(r) for r in K.top_k(one.where("vec_id = 0"), one, "vec_id", "v", 3).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]


def test_select_keeps_ties_by_id():
    s, i = K.select(np.array([5, 7, 7, 7, 1]), np.array([9, 8, 3, 5, 1]), 3, 2)
    assert s.tolist() == [7, 7] and i.tolist() == [5, 8]


def test_large_components_take_part(spark):
    rows = [(0, [1e13, 0.0]), (1, [0.001, 1.0]), (2, [0.002, 1.0]), (3, [-1e13, 0.0]), (4, [-1e300, 1.0])]
    q = K.quantised(spark.createDataFrame(rows, "vec_id long, v array<double>"), "v", 1024)
    got = sorted(tuple(r) for r in K.top_k(q.where("vec_id in (0, 1)"), q, "vec_id", "v", 4).collect())
    big, limit = 1024 * 10**13, 2**63
    assert got[:4] == [(0, 1, 2, 2 * big), (0, 2, 1, big), (0, 3, 3, -limit), (0, 4, 4, -limit)]
    assert got[4:] == [(1, 1, 0, big), (1, 2, 2, 2 + 1024**2), (1, 3, 3, -big), (1, 4, 4, -limit + 1024**2)]


def test_many_waves_write_their_lists(spark, monkeypatch):
    """Fifty waves and more: shards are packed once and no plan holds all waves."""
    monkeypatch.setattr(K, "WAVE_ROWS", 8)
    monkeypatch.setattr(K, "BLOCK_ROWS", 4)
    packed = []
    monkeypatch.setattr(K, "checkpointed", lambda df, real=K.checkpointed: packed.append(df) or real(df))
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(220)]
    q = K.quantised(spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3), "v", 1024)
    found = K.top_k(q, q, "vec_id", "v", 3)
    assert len(packed) == 2 and len(found._jdf.queryExecution().analyzed().toString().splitlines()) < 20
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 1, 3)


def test_small_integers_hold_what_they_must():
    for top in (32767, -32768, 32768, 2**31 - 1, -(2**31), 2**31, 2**62):
        m = np.array([[top, 0], [1, -1]])
        packed = K._small(m)
        assert (K._matrix(packed.tobytes(), 2, 2) == m).all()
