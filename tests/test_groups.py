import pytest

from tests.helpers import NA, NAN, frame, rows, values
from verbspark import col, functions as f
from verbspark.plans.expr import quoted


def test_summarise(spark):
    x = frame(spark, "x int", *range(1, 11))
    assert rows(x.summarise(y=f.mean("x"), z=col("y") + 1)) == [(5.5, 6.5)]
    none = frame(spark, "g int, x int")
    assert rows(none.summarise(n=f.n(), s=f.sum("x"))) == [(0, 0)] and rows(none.group_by("g").summarise(n=f.n())) == []
    g = frame(spark, "g double, x double", (2.0, 4.0), (1.0, 2.0), (2.0, 8.0), (0.0, 5.0))
    assert rows(g.summarise(m=f.mean("x"), _by="g")) == [(2, 6), (1, 2), (0, 5)]
    assert rows(g.group_by("g").summarise(m=f.mean("x"))) == [(0, 5), (1, 2), (2, 6)]
    assert rows(g.group_by("g").summarise(x=f.mean("x"), s=f.sum("x"), d=f.sd("x"))) == [(0, 5, 5, NA), (1, 2, 2, NA), (2, 6, 6, NA)]
    with pytest.raises(ValueError):
        g.group_by("g").summarise(a=col("x"))
    s = frame(spark, "x string", "apple", NA, "banana")
    assert values(s.group_by("x").summarise(n=f.n()), "x") == ["apple", "banana", NA]


def test_groups_after_summarise(spark):
    x = frame(spark, "a int, b int, v int", (1, 1, 1), (1, 2, 2))
    g = x.group_by("a", "b")
    assert g.summarise(n=f.n()).groups == ("a",) and g.summarise(n=f.n(), _groups="drop").groups == () and g.summarise(n=f.n(), _groups="keep").groups == ("a", "b")
    assert g.summarise(n=f.n(), _groups="rowwise").is_rowwise and x.summarise(n=f.n(), _by=["a", "b"]).groups == ()
    assert x.group_by("a").group_by("b", _add=True).groups == ("a", "b") and g.ungroup("a").groups == ("b",) and g.ungroup().groups == ()
    assert x.group_by(s=col("a") + col("b")).n_groups() == 2
    assert g.with_groups("a", lambda t: t.summarise(n=f.n())).columns == ["a", "n"]


def test_missing_values(spark):
    x = frame(spark, "g int, x double, b boolean", (1, 1.0, True), (1, NA, NA), (2, 3.0, False), (2, 5.0, NA), (3, NAN, False))
    out = x.group_by("g").summarise(s=f.sum("x"), m=f.mean("x"), lo=f.min("x"), a=f.any("b"), e=f.all("b"))
    assert rows(out) == [(1, NA, NA, NA, True, NA), (2, 8, 4, 3, NA, False), (3, "NaN", "NaN", "NaN", False, False)]
    out = x.filter(col("g") < 3).group_by("g").summarise(s=f.sum("x", na_rm=True), m=f.mean("x", na_rm=True), v=f.var("x"), d=f.median("x", na_rm=True))
    assert rows(out) == [(1, 1, 1, NA, 1), (2, 8, 4, 2, 4)]
    q = frame(spark, "x double", 1.0, 2.0, 3.0, 4.0)
    assert rows(q.summarise(a=f.quantile("x", 0.25), b=f.iqr("x"), c=f.mad("x"), p=f.prod("x"))) == [(1.75, 1.5, 1.4826, 24)]


def test_n_distinct(spark):
    x = frame(spark, "a int, b int", (1, 1), (1, 2), (2, 2), (NA, 1), (1, 1))
    assert rows(x.summarise(a=f.n_distinct("a"), ab=f.n_distinct("a", "b"), r=f.n_distinct("a", "b", na_rm=True))) == [(3, 4, 3)]
    assert values(x.group_by("b").mutate(k=f.n_distinct("a")), "k") == [2, 2, 2, 2, 2]
    assert values(x.group_by("b").mutate(k=f.n_distinct("a", na_rm=True)), "k") == [1, 2, 2, 1, 1]
    assert rows(x.summarise(k=f.approx_n_distinct("a"))) == [(2,)]


def test_positions(spark):
    x = frame(spark, "g int, o int, v string", (1, 3, "a"), (1, 1, NA), (2, 2, "c"), (1, 2, "d"))
    out = x.group_by("g").summarise(a=f.first("v"), b=f.last("v"), c=f.first("v", order_by="o"), d=f.last("v", order_by="o", na_rm=True), e=f.first("v", order_by="o", na_rm=True))
    assert rows(out) == [(1, "a", "d", NA, "a", "d"), (2, "c", "c", "c", "c", "c")]
    out = x.group_by("g").summarise(a=f.nth("v", 2), b=f.nth("v", -1), c=f.nth("v", 2, default="x"), d=f.nth("v", 2, na_rm=True), e=f.nth("v", 1, order_by="o"))
    assert rows(out) == [(1, NA, "d", NA, "d", NA), (2, NA, "c", "x", NA, "c")]
    assert values(x.mutate(z=f.first("o")), "z") == [3] * 4 and values(x.group_by("g").mutate(z=f.nth("o", 2)), "z") == [1, 1, NA, 1]


def test_counts(spark):
    x = frame(spark, "x double, w int", (2.0, 1), (1.0, 2), (1.0, NA), (2.0, 4), (1.0, 5))
    assert rows(x.count("x")) == [(1, 3), (2, 2)] and rows(x.count("x", _wt="w")) == [(1, 7), (2, 5)]
    assert rows(frame(spark, "x double", 1.0, 1.0, 2.0, 2.0, 2.0).count("x", _sort=True)) == [(2, 3), (1, 2)]
    assert frame(spark, "n double", 1.0, 1.0, 2.0).count("n").columns == ["n", "nn"] and x.count("x", _name="k").columns == ["x", "k"]
    assert values(x.add_count("x"), "n") == [2, 3, 3, 2, 3] and values(x.add_tally(), "n") == [5] * 5 and rows(x.tally()) == [(5,)]
    assert x.group_by("x").count("w").groups == ("x",) and x.group_by("x").tally().groups == ()
    assert rows(x.count(big=col("x") > 1)) == [(False, 3), (True, 2)]


def test_reframe(spark):
    x = frame(spark, "g double, x int", (1.0, 1), (1.0, 2), (1.0, 3), (2.0, 4), (2.0, 5))
    out = x.reframe(w=f.which(col("x") > 2), _by="g")
    assert rows(out) == [(1, 3), (2, 1), (2, 2)]
    out = x.reframe(a=f.c_array(1, 2), b=1, c=f.c_array(2, 3), _by="g")
    assert rows(out) == [(1, 1, 1, 2), (1, 2, 1, 3), (2, 1, 1, 2), (2, 2, 1, 3)]
    assert rows(x.group_by("g").reframe(v=f.values("x"))) == [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5)]
    assert rows(x.reframe(q=f.c_array(f.min("x"), f.max("x")))) == [(1,), (5,)]
    with pytest.raises(Exception, match="lengths"):
        x.reframe(a=f.c_array(1, 2), b=f.c_array(1, 2, 3)).collect()


def test_group_metadata(spark):
    x = frame(spark, "x string, v int", ("b", 1), ("a", 2), ("b", 3))
    g = x.group_by("x")
    assert g.group_vars() == ["x"] and rows(g.group_keys()) == [("a",), ("b",)] and g.n_groups() == 2 and g.group_size() == [1, 2]
    assert values(g.group_indices(), ".group") == [2, 1, 2] and g.group_rows() == [[2], [1, 3]] and x.group_rows() == [[1, 2, 3]]
    assert values(g.mutate(i=f.cur_group_id()), "i") == [2, 1, 2] and values(g.mutate(i=f.cur_group_rows()), "i") == [1, 2, 3]
    assert [r.i.x for r in g.mutate(i=f.cur_group()).collect()] == ["b", "a", "b"]


def test_nesting_and_functions(spark):
    x = frame(spark, "x string, v int", ("b", 1), ("a", 2), ("b", 3))
    g = x.group_by("x")
    nested = g.group_nest()
    assert [(r.x, [i.v for i in r.data]) for r in nested.collect()] == [("a", [2]), ("b", [1, 3])] and rows(nested.unnest("data")) == [("a", 2), ("b", 1), ("b", 3)]
    assert x.nest_by("x").is_rowwise and [len(p.collect()) for p in g.group_split()] == [1, 2] and g.group_split(_keep=False)[0].columns == ["v"]
    assert g.group_map(lambda part, key: (key.x, sum(part.pull("v")))) == [("a", 2), ("b", 4)]
    seen = []
    assert g.group_walk(lambda part, key: seen.append(key.x)) is g and seen == ["a", "b"]
    out = g.group_modify(lambda d, key: d.assign(total=d.v.sum())[["v", "total"]], "v int, total long")
    assert rows(out) == [("a", 2, 2), ("b", 1, 4), ("b", 3, 4)] and out.groups == ("x",)
    with pytest.raises(ValueError):
        g.group_modify(lambda d, key: d, "x string")
    assert rows(x.summarise(m=f.pandas_agg(lambda v: float(v.max()), "double", "v"), _by="x").arrange("x")) == [("a", 2), ("b", 3)]
    assert values(x.mutate(m=f.pandas_scalar(lambda v: v + 1, "int", "v")), "m") == [2, 3, 4]


def test_factor_levels_without_rows(spark):
    x = frame(spark, "f string, g int, v int", ("a", 1, 1), ("a", 1, 2), ("b", 2, 3))
    leveled = x.factor("f", ["a", "b", "c"])
    turned = x.factor("f", ["c", "b", "a"])
    assert values(turned.arrange("f"), "f") == ["b", "a", "a"] and rows(turned.count("f", _drop=False)) == [("c", 0), ("b", 1), ("a", 2)]
    assert rows(turned.group_by("f").summarise(n=f.n())) == [("b", 1), ("a", 2)] and values(x.factor("f", ["a"]), "f") == ["a", "a", NA]
    assert rows(x.factor("f").recode_factor("f", {"b": "z"}).count("f")) == [("z", 1), ("a", 2)]
    assert rows(leveled.count("f", _drop=False)) == [("a", 2), ("b", 1), ("c", 0)]
    assert sorted(rows(leveled.group_by("f", "g", _drop=False).summarise(n=f.n(), m=f.mean("v"), _groups="drop")), key=str) == sorted([("a", 1, 2, 1.5), ("b", 2, 1, 3.0), ("c", NA, 0, NA)], key=str)
    assert leveled.group_by("f").group_trim().schema["f"].metadata["levels"] == ["a", "b"]


def test_cube_and_rollup(spark):
    x = frame(spark, "a int, b int", (1, 1), (1, 2), (2, 1))
    assert x.rollup("a", "b", n=f.n())._df.count() == 6 and x.cube("a", "b", n=f.n())._df.count() == 8


def test_scoped_verbs(spark):
    from verbspark import all_vars, any_vars, is_numeric, vars_

    x = frame(spark, "g string, a int, b int", ("u", 1, 2), ("v", 3, 0), ("u", 5, 6))
    assert rows(x.mutate_if(is_numeric, lambda v: v + 1)) == [("u", 2, 3), ("v", 4, 1), ("u", 6, 7)]
    assert x.group_by("g").summarise_all([f.min, f.max]).columns == ["g", "a_1", "b_1", "a_2", "b_2"]
    assert x.summarise_at("a", {"lo": f.min, "hi": f.max}).columns == ["lo", "hi"] and rows(x.summarise_at(vars_("a", "b"), f.sum)) == [(9, 8)]
    assert x.transmute_at(["a"], lambda v: -v).columns == ["a"] and x.mutate_at(["b"], {"twice": lambda v: v * 2}).columns == ["g", "a", "b", "twice"]
    assert len(x.filter_if(is_numeric, any_vars(lambda v: v > 4)).collect()) == 1 and len(x.filter_at(["a", "b"], all_vars(lambda v: v > 0)).collect()) == 2
    assert values(x.arrange_at(["b"]), "b") == [0, 2, 6] and x.distinct_at(["g"])._df.count() == 2 and x.group_by_if(lambda t: not is_numeric(t)).groups == ("g",)
    assert x.select_if(is_numeric, str.upper).columns == ["A", "B"] and x.rename_all(str.upper).columns == ["G", "A", "B"] and x.select_at(["a"]).columns == ["a"]
    assert x.group_by("g").mutate_all(lambda v: v * 0).columns == ["g", "a", "b"] and quoted("a.b") is not None
