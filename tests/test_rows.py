import pytest

from tests.helpers import NA, NAN, frame, rows, values
from verbspark import col, desc, functions as f, if_all, if_any, is_numeric, pick, where


def test_filter_and_its_complement(spark):
    x = frame(spark, "i int, x int", (1, NA), (2, 1), (3, 1), (4, 0), (5, 0))
    assert values(x.filter(col("x") == 1), "i") == [2, 3]
    assert values(x.filter_out(col("x") == 1), "i") == [1, 4, 5]
    grid = frame(spark, "x boolean, y boolean", *[(a, b) for a in (True, False, NA) for b in (True, False, NA)])
    kept, dropped = grid.filter(col("x"), col("y")), grid.filter_out(col("x"), col("y"))
    assert sorted(map(str, rows(kept) + rows(dropped))) == sorted(map(str, rows(grid)))


def test_filter_by_group_values(spark):
    x = frame(spark, "g double, x double", (1.0, 5.0), (1.0, 10.0), (2.0, 1.0), (1.0, 2.0), (2.0, 3.0))
    assert rows(x.filter(col("x") > f.mean("x"), _by="g")) == [(1, 10), (2, 3)]
    assert rows(x.filter_out(col("x") > f.mean("x"), _by="g")) == [(1, 5), (2, 1), (1, 2)]
    assert rows(x.filter(col("x") > f.mean("x"))) == [(1, 5), (1, 10)]
    with pytest.raises(ValueError):
        x.group_by("g").filter(col("x") > 1, _by="g")
    with pytest.raises(TypeError):
        x.filter(col("x") == "a").collect()


def test_if_any_and_if_all(spark):
    x = frame(spark, "a int, b int, s string", (1, 0, "u"), (1, 1, "v"), (0, 0, "w"))
    assert values(x.filter(if_any(where(is_numeric), lambda v: v == 1)), "s") == ["u", "v"]
    assert values(x.filter(if_all(where(is_numeric), lambda v: v == 1)), "s") == ["v"]
    assert x.filter(if_any([], lambda v: v == 1)).collect() == [] and len(x.filter(if_all([], lambda v: v == 1)).collect()) == 3


def test_arrange(spark):
    x = frame(spark, "k double, s string, i int", (2.0, "b", 1), (NA, "a", 2), (NAN, "B", 3), (1.0, "A", 4), (2.0, "c", 5))
    assert values(x.arrange("k"), "i") == [4, 1, 5, 2, 3]
    assert values(x.arrange(desc("k")), "i") == [1, 5, 4, 2, 3]
    assert values(x.arrange("s"), "s") == ["A", "B", "a", "b", "c"]
    assert values(x.arrange("s", _locale="en"), "s") == ["a", "A", "b", "B", "c"]
    assert values(x.arrange(pick("k", "s")), "i") == [4, 1, 5, 3, 2]
    assert values(x.arrange(desc(col("i") % 2), "i"), "i") == [1, 3, 5, 2, 4]
    grouped = x.group_by("s").arrange("i")
    assert values(grouped, "i") == [1, 2, 3, 4, 5] and grouped.groups == ("s",)
    assert values(x.group_by("s").arrange(desc("i"), _by_group=True), "s") == ["A", "B", "a", "b", "c"]


def test_slice(spark):
    x = frame(spark, "g string, i int", ("b", 1), ("a", 2), ("b", 3), ("a", 4), ("a", 5))
    assert values(x.slice(3, 1, 1, 0, 99), "i") == [3, 1, 1]
    assert values(x.slice(-1, -5), "i") == [2, 3, 4]
    assert values(x.slice(f.n()), "i") == [5] and x.slice().collect() == []
    assert values(x.group_by("g").slice(2), "i") == [4, 3]
    assert values(x.slice(1, _by="g"), "i") == [2, 1]
    with pytest.raises(ValueError):
        x.slice(1, -1)
    with pytest.raises(TypeError):
        x.slice("a")


def test_slice_head_and_tail(spark):
    x = frame(spark, "g int, i int", *[(k // 4, k) for k in range(8)])
    assert values(x.slice_head(3), "i") == [0, 1, 2] and values(x.slice_tail(2), "i") == [6, 7]
    assert values(x.slice_head(-6), "i") == [0, 1] and values(x.slice_tail(-6), "i") == [6, 7]
    assert values(x.slice_head(prop=0.3), "i") == [0, 1] and values(x.slice_head(), "i") == [0]
    assert values(x.group_by("g").slice_head(1), "i") == [0, 4] and values(x.slice_tail(1, _by="g"), "i") == [3, 7]
    assert len(x.slice_head(99).collect()) == 8


def test_slice_min_and_max(spark):
    x = frame(spark, "id int, x double", (1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0), (5, 2.0))
    assert values(x.slice_min("x"), "id") == [1, 2, 3] and values(x.slice_max("x"), "id") == [4, 5]
    assert values(x.slice_min("x", with_ties=False), "id") == [1] and values(x.slice_max("x", with_ties=False), "id") == [4]
    x = frame(spark, "id int, x double", (1, 2.0), (2, 3.0), (3, 1.0), (4, 2.0))
    assert values(x.slice_min("x", 2), "id") == [3, 1, 4] and values(x.slice_max("x", 2), "id") == [2, 1, 4]
    x = frame(spark, "id int, x double", (1, 1.0), (2, NA), (3, NA))
    assert values(x.slice_max("x", 1), "id") == [1] and values(x.slice_min("x", 2), "id") == [1, 2, 3]
    assert values(x.slice_min("x", 2, with_ties=False), "id") == [1, 2]
    x = frame(spark, "id int, x double", (1, 2.0), (2, NA), (3, 1.0), (4, 2.0))
    assert values(x.slice_min("x", 2, na_rm=True), "id") == [3, 1, 4] and values(x.slice_max("x", 2, na_rm=True), "id") == [1, 4]
    x = frame(spark, "id int, a double, b double", (1, 1.0, 2.0), (2, 2.0, NA), (3, NA, NA))
    assert values(x.slice_min(["a", "b"], 3, na_rm=True), "id") == [1]
    g = frame(spark, "g string, v int", ("a", 3), ("b", 1), ("a", 4), ("b", 2), ("a", 4))
    assert rows(g.group_by("g").slice_max("v")) == [("a", 4), ("a", 4), ("b", 2)]
    assert rows(g.slice_min("v", prop=0.5, _by="g")) == [("a", 3), ("b", 1)]


def test_samples(spark):
    x = frame(spark, "g int, i int, w double", *[(k % 3, k, float(k % 2)) for k in range(60)])
    got = values(x.slice_sample(7, seed=1), "i")
    assert len(got) == len(set(got)) == 7
    assert len(x.slice_sample(99).collect()) == 60 and len(x.slice_sample(prop=0.25).collect()) == 15
    per = rows(x.group_by("g").slice_sample(4, seed=2).count())
    assert per == [(0, 4), (1, 4), (2, 4)]
    assert all(i % 2 for i in values(x.slice_sample(30, weight_by="w", seed=3), "i"))
    many = values(x.slice_sample(500, replace=True, weight_by="w", seed=4), "i")
    assert len(many) == 500 and all(i % 2 for i in many) and len(set(many)) > 20
    assert len(x.sample_n(5).collect()) == 5 and len(x.sample_frac(0.5).collect()) == 30
    with pytest.raises(ValueError):
        x.sample_n(61)


def test_top_n(spark):
    x = frame(spark, "i int, v int", (1, 5), (2, 9), (3, 7), (4, 9), (5, NA))
    assert values(x.top_n(2), "i") == [2, 4] and values(x.top_n(3, "v"), "i") == [2, 3, 4]
    assert values(x.top_n(-1, "v"), "i") == [1] and values(x.top_frac(0.4, "v"), "i") == [2, 4]


def test_distinct(spark):
    x = frame(spark, "x double, y double, z double", (1.0, 1.0, 1.0), (1.0, 1.0, 2.0), (1.0, 2.0, 1.0), (1.0, 2.0, 2.0))
    assert len(x.distinct().collect()) == 4 and rows(x.distinct("x")) == [(1,)]
    assert rows(x.distinct("y", _keep_all=True)) == [(1, 1, 1), (1, 2, 1)]
    assert values(x.distinct(s=col("y") + col("z")), "s") == [2, 3, 4]
    y = frame(spark, "g int, x int", (2, 1), (1, NA), (2, 1), (1, NA), (3, 5))
    assert rows(y.distinct()) == [(2, 1), (1, NA), (3, 5)]
    assert y.group_by("g").distinct("x").columns == ["g", "x"]
