import pytest

from tests.helpers import NA, NAN, frame, rows, values
from verbspark import common_by, join_by
from verbspark.plans.joinspec import Condition


def test_columns_and_order(spark):
    a = frame(spark, "a int, b double, c double", (1, 1.0, 1.0), (2, 2.0, 2.0), (3, 3.0, 3.0)).select("a", "b")
    e = frame(spark, "c double, a int", (1.0, 4), (2.0, 3), (3.0, 2), (4.0, 1))
    assert a.left_join(e, "a").columns == ["a", "b", "c"]
    assert [values(getattr(a, f"{k}_join")(e, "a"), "a") for k in ("inner", "left", "right", "full")] == [[1, 2, 3], [1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4]]
    x = frame(spark, "x double, z int, a double", (1.0, 1, 1.0), (1.0, 2, 2.0), (2.0, 3, 3.0), (3.0, 4, 4.0))
    y = frame(spark, "z int, b double, x double, a double", (1, 1.0, 1.0, 1.0), (2, 1.0, 2.0, 1.0), (3, 1.0, 4.0, 1.0))
    assert x.left_join(y.select("z", "b", "x"), "x").columns == ["x", "z.x", "a", "z.y", "b"]
    assert x.left_join(y, "x", suffix=("", "_r")).columns == ["x", "z", "a", "z_r", "b", "a_r"]
    assert x.inner_join(y, {"z": "z"}, keep=True).columns == ["x.x", "z.x", "a.x", "z.y", "b", "x.y", "a.y"]
    assert common_by(None, x, y) == {"x": "x", "z": "z", "a": "a"}


def test_keys_2_1_against_3_4_1(spark):
    x, y = frame(spark, "k int", 2, 1), frame(spark, "k int", 3, 4, 1)
    assert rows(x.inner_join(y, "k")) == [(1,)] and rows(x.left_join(y, "k")) == [(2,), (1,)]
    assert rows(x.right_join(y, "k")) == [(1,), (3,), (4,)] and rows(x.full_join(y, "k")) == [(2,), (1,), (3,), (4,)]
    assert rows(x.inner_join(y, join_by("k > k"))) == [(2, 1)] and rows(x.full_join(y, join_by("k >= k"))) == [(2, 1), (1, 1), (NA, 3), (NA, 4)]


def test_missing_keys(spark):
    x, y = frame(spark, "a double", 1.0, NA), frame(spark, "a double, b int", (1.0, 1), (NA, 2))
    assert rows(x.left_join(y, "a")) == [(1, 1), (NA, 2)] and rows(x.left_join(y, "a", na_matches="never")) == [(1, 1), (NA, NA)]
    assert len(x.full_join(y, "a", na_matches="never").collect()) == 3 and rows(x.semi_join(y, "a", na_matches="never")) == [(1,)]
    assert rows(x.anti_join(y, "a")) == [] and rows(x.anti_join(y, "a", na_matches="never")) == [(NA,)]
    n, m = frame(spark, "a double", NAN), frame(spark, "a double", NA)
    assert rows(n.inner_join(n, "a")) == [("NaN",)] and rows(n.inner_join(m, "a")) == [] and rows(n.inner_join(n, "a", na_matches="never")) == []
    k = frame(spark, "k int", NA)
    assert [len(k.inner_join(k, join_by(f"k {op} k")).collect()) for op in ("==", ">=", "<=", ">", "<")] == [1, 1, 1, 0, 0]
    assert [len(k.inner_join(k, join_by(f"k {op} k"), na_matches="never").collect()) for op in ("==", ">=", "<=")] == [0, 0, 0]


def test_closest(spark):
    x, y = frame(spark, "x int", 1, 2, 3, 4, 5), frame(spark, "y double", 1.0, 2.0, 4.0)
    got = {op: values(x.left_join(y, join_by(f"closest(x {op} y)")), "y") for op in ("<=", "<", ">=", ">")}
    assert got == {"<=": [1, 2, 4, 4, NA], "<": [2, 4, 4, NA, NA], ">=": [1, 2, 2, 4, 4], ">": [NA, 1, 2, 2, 4]}
    assert values(x.inner_join(y, join_by("closest(x <= y)")), "x") == [1, 2, 3, 4]
    assert rows(x.full_join(frame(spark, "y int", 1, 9), join_by("closest(x >= y)")))[-1] == (NA, 9)
    g = frame(spark, "g string, t int", ("a", 5), ("b", 5), (NA, 5), ("a", NA))
    h = frame(spark, "g string, s int, v int", ("a", 3, 1), ("a", 3, 2), ("a", 9, 3), ("b", 6, 4), (NA, 2, 5))
    assert rows(g.left_join(h, join_by("g", "closest(t >= s)"))) == [("a", 5, 3, 1), ("a", 5, 3, 2), ("b", 5, NA, NA), (NA, 5, 2, 5), ("a", NA, NA, NA)]
    assert rows(g.left_join(h, join_by("g", "closest(t >= s)", "t < v"))) == rows(g.left_join(h.filter(False), join_by("g", "closest(t >= s)", "t < v")))


def test_ranges(spark):
    x, y = frame(spark, "x int", 1, 2, 3, 4, 5), frame(spark, "lo int, hi int", (2, 4))
    got = {b: values(x.inner_join(y, join_by(f"between(x, lo, hi, bounds = '{b}')")), "x") for b in ("[]", "[)", "(]", "()")}
    assert got == {"[]": [2, 3, 4], "[)": [2, 3], "(]": [3, 4], "()": [3]}
    r = frame(spark, "a int, b int", (1, 2), (1, 3), (3, 4), (4, 5))
    assert len(r.inner_join(y, join_by("overlaps(a, b, lo, hi)")).collect()) == 4 and values(r.inner_join(y, join_by("overlaps(a, b, lo, hi, bounds = '()')")), "a") == [1, 3]
    assert values(r.inner_join(y, join_by("within(a, b, lo, hi)")), "a") == [3] and values(r.inner_join(y, join_by("within(y$lo, y$hi, x$a, x$b)")), "a") == []
    assert join_by("y$lo <= x$a").conditions == (Condition("a", ">=", "lo"),) and join_by("between(y$lo, x$a, x$b)").conditions == (Condition("a", "<=", "lo"), Condition("b", ">=", "lo"))
    for bad in ((), ("closest(a == b)",), ("a + b",), ("x$a > x$b",), ("between(a, b)",), ("overlaps(a, b, c, d, bounds = '[[')",)):
        with pytest.raises(ValueError):
            join_by(*bad)


def test_contracts(spark):
    x, y = frame(spark, "k int", 1, 1, 3), frame(spark, "k int, v int", (1, 1), (1, 2), (2, 3))
    assert [values(x.left_join(y, "k", multiple=m), "v") for m in ("first", "last")] == [[1, 1, NA], [2, 2, NA]] and len(x.left_join(y, "k", multiple="any").collect()) == 3
    assert values(x.left_join(y, join_by("k <= k"), multiple="last"), "v") == [3, 3, NA] and values(x.inner_join(y, join_by("k <= k"), multiple="first"), "v") == [1, 1]
    for more in ({"unmatched": "error"}, {"relationship": "one-to-one"}, {"relationship": "one-to-many"}, {"relationship": "many-to-one"}, {"unmatched": ("drop", "error")}):
        with pytest.raises(ValueError):
            x.inner_join(y, "k", **more)
    assert len(x.left_join(y, "k", relationship="many-to-many").collect()) == 5
    with pytest.raises(TypeError):
        x.left_join(frame(spark, "k string", "a"), "k")
    with pytest.raises(KeyError):
        x.left_join(y, "zz")
    with pytest.raises(ValueError):
        x.left_join(y, join_by("k > k"), keep=False)
    assert x.left_join(frame(spark, "k double", 1.0), "k").schema["k"].dataType.simpleString() == "double"
    assert frame(spark, "g int, k int", (1, 1)).group_by("g").left_join(y, "k").groups == ("g",)


def test_nest_and_cross(spark):
    x, y = frame(spark, "x double, y int", (1.0, 2), (2.0, 3)), frame(spark, "x double, z int", (1.0, 2), (1.0, 3))
    assert [len(r.yy) for r in x.nest_join(y, "x", name="yy").collect()] == [2, 0]
    assert [[i.z for i in r.m] for r in x.nest_join(y, join_by("y >= z"), name="m").collect()] == [[2], [2, 3]]
    assert rows(x.select("y").cross_join(y.select("z"))) == [(2, 2), (2, 3), (3, 2), (3, 3)] and x.cross_join(x).columns == ["x.x", "y.x", "x.y", "y.y"]
    import pandas as pd

    assert len(x.left_join(pd.DataFrame({"x": [1.0]}), "x", copy=True).collect()) == 2
    with pytest.raises(TypeError):
        x.left_join(pd.DataFrame({"x": [1.0]}), "x")


@pytest.mark.parametrize("width", [1, 3, 50])
def test_binned_range_joins(spark, width):
    import random

    rng = random.Random(width)
    x = frame(spark, "x int, a int, b int", *[(rng.randint(0, 60), *sorted((rng.randint(0, 60), rng.randint(0, 60)))) for _ in range(40)], (NA, NA, NA))
    y = frame(spark, "lo int, hi double", *[(k, float(k + rng.randint(0, 20))) for k in (rng.randint(0, 60) for _ in range(30))], (NA, 1.0))
    for by in ("between(x, lo, hi)", "between(x, lo, hi, bounds = '()')", "overlaps(a, b, lo, hi)", "within(a, b, lo, hi)"):
        plain = sorted(map(str, rows(x.inner_join(y, join_by(by), na_matches="never"))))
        assert sorted(map(str, rows(x.inner_join(y, join_by(by), na_matches="never", bin_width=width)))) == plain and plain
    left = join_by("between(x, lo, hi)")
    assert sorted(map(str, rows(x.left_join(y, left, na_matches="never", bin_width=width)))) == sorted(map(str, rows(x.left_join(y, left, na_matches="never"))))
    with pytest.raises(ValueError):
        x.left_join(y, join_by("overlaps(a, b, lo, hi)"), bin_width=1)
    with pytest.raises(ValueError):
        x.inner_join(y, join_by("x > lo"), bin_width=1)
