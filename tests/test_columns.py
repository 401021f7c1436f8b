import pytest

from tests.helpers import NA, NAN, frame, rows, values
from verbspark import across, all_of, any_of, col, contains, ends_with, everything, functions as f, group_cols, is_character, is_numeric, last_col, matches, num_range, pick, span, starts_with, where


@pytest.fixture(scope="module")
def t(spark):
    return frame(spark, "x1 int, x2 int, name string, y double", (1, 2, "a", 0.5), (3, 4, "b", 1.5))


def test_select_and_helpers(t):
    assert t.select("name", "x1").columns == ["name", "x1"]
    assert t.select(label="name").columns == ["label"]
    assert t.select(starts_with("x")).columns == ["x1", "x2"] and t.select(ends_with("E")).columns == ["name"]
    assert t.select(contains("a")).columns == ["name"] and t.select(matches("^x[0-9]$")).columns == ["x1", "x2"]
    assert t.select(num_range("x", [2, 1])).columns == ["x2", "x1"] and t.select(last_col()).columns == ["y"]
    assert t.select(where(is_character)).columns == ["name"] and t.select(where(is_numeric) & ~starts_with("x")).columns == ["y"]
    assert t.select(span("x2", "y")).columns == ["x2", "name", "y"] and t.select("y", everything()).columns == ["y", "x1", "x2", "name"]
    assert t.select(any_of(["y", "zz"])).columns == ["y"] and t.select(~all_of(["y"])).columns == ["x1", "x2", "name"]
    assert t.select(-1, 1).columns == ["y", "x1"] and t.select(v=starts_with("x")).columns == ["v1", "v2"]
    with pytest.raises(KeyError):
        t.select(all_of(["zz"]))
    grouped = t.group_by("name").select("y")
    assert grouped.columns == ["name", "y"] and grouped.select(group_cols()).columns == ["name"]
    assert t.group_by("name").select(label="name").groups == ("label",)


def test_rename_and_relocate(t):
    assert t.rename(z="x2").columns == ["x1", "z", "name", "y"]
    assert t.rename_with(str.upper, starts_with("x")).columns == ["X1", "X2", "name", "y"]
    assert t.relocate("y").columns == ["y", "x1", "x2", "name"]
    assert t.relocate("x1", _after="name").columns == ["x2", "name", "x1", "y"]
    assert t.relocate("y", "name", _before="x2").columns == ["x1", "y", "name", "x2"]
    with pytest.raises(ValueError):
        t.rename_with(lambda _: "a")
    with pytest.raises(ValueError):
        t.relocate("y", _before="x1", _after="x2")


def test_mutate(t):
    out = t.mutate(a=col("x1") + 1, b=col("a") * 2, x1=col("x1") * 10, x2=None)
    assert out.columns == ["x1", "name", "y", "a", "b"] and rows(out) == [(10, "a", 0.5, 2, 4), (30, "b", 1.5, 4, 8)]
    assert rows(t.mutate(m=f.mean("y"), n=f.n()).select("m", "n")) == [(1.0, 2), (1.0, 2)]
    assert t.mutate(z=col("x1") + col("x2"), _keep="used").columns == ["x1", "x2", "z"]
    assert t.mutate(z=col("x1"), _keep="unused").columns == ["x2", "name", "y", "z"]
    assert t.mutate(z=col("x1"), _keep="none").columns == ["z"]
    assert t.mutate(z=1, _before="name").columns == ["x1", "x2", "z", "name", "y"] and t.mutate(z=1, _after="x1").columns == ["x1", "z", "x2", "name", "y"]
    assert t.transmute(z=col("x1"), w=col("z") + 1).columns == ["z", "w"]
    assert t.group_by("name").transmute(z=col("x1")).columns == ["name", "z"]
    assert values(t.mutate(r=col("y") / 0), "r") == [float("inf")] * 2 and values(t.mutate(r=-col("y") / 0), "r") == [float("-inf")] * 2
    assert values(t.mutate(s=(col("y") - col("y")) / 0), "s") == ["NaN", "NaN"]
    assert values(t.mutate(m=(col("x1") - 5) % 3, d=(col("x1") - 5) // 3), "m") == [2, 1]


def test_across_and_pick(t):
    out = t.mutate(across(starts_with("x"), lambda v: v * 2))
    assert rows(out)[0][:2] == (2, 4)
    out = t.mutate(across(starts_with("x"), {"dbl": lambda v: v * 2, "neg": lambda v: -v}))
    assert out.columns == ["x1", "x2", "name", "y", "x1_dbl", "x1_neg", "x2_dbl", "x2_neg"]
    assert t.summarise(across(where(is_numeric), [f.mean, f.max])).columns == ["x1_1", "x1_2", "x2_1", "x2_2", "y_1", "y_2"]
    assert t.summarise(across(starts_with("x"), f.sum, names="sum_{col}")).columns == ["sum_x1", "sum_x2"]
    assert t.group_by("name").summarise(across(everything(), f.n_distinct)).columns == ["name", "x1", "x2", "y"]
    assert t.group_by("name").mutate(pick(everything())).columns == t.columns
    assert rows(t.rowwise().mutate(s=f.c_array("x1", "x2")).select("s")) == [([1, 2],), ([3, 4],)]
    ends = t.summarise(across(starts_with("x"), lambda v: {"lo": f.min(v), "hi": f.max(v)}))
    assert ends.columns == ["x1_lo", "x1_hi", "x2_lo", "x2_hi"] and rows(ends) == [(1, 3, 2, 4)]
    assert values(t.mutate(across("y", lambda v: f.paste(v.name))), "y") and t.summarise(across("y", {"m": f.mean})).columns == ["y_m"]
    with pytest.raises(ValueError):
        pick()


def test_pull_and_looks(t):
    assert t.pull() == [0.5, 1.5] and t.pull("name") == ["a", "b"] and t.pull(1) == [1, 3] and t.pull("x1", "name") == {"a": 1, "b": 3}
    assert t.dim_desc() == "[2 x 4]" and "name <string> a, b" in t.glimpse() and t.group_by("y").tbl_nongroup_vars() == ["x1", "x2", "name"]
    assert t.show_query() and t.tbl_ptype().count() == 0


def test_windows(spark):
    x = frame(spark, "x double", 1.0, 2.0, NA, 1.0, 0.0, NAN)
    out = x.mutate(a=f.min_rank("x"), b=f.dense_rank("x"), c=f.row_number(col("x")), d=f.percent_rank("x"), e=f.cume_dist("x"))
    assert values(out, "a") == [2, 4, NA, 2, 1, NA] and values(out, "b") == [2, 3, NA, 2, 1, NA] and values(out, "c") == [2, 4, NA, 3, 1, NA]
    assert values(out, "d") == [1 / 3, 1.0, NA, 1 / 3, 0.0, NA] and values(out, "e") == [0.75, 1.0, NA, 0.75, 0.25, NA]
    assert values(frame(spark, "x double", 5.0).mutate(p=f.percent_rank("x")), "p") == ["NaN"]
    y = frame(spark, "y double, m double", (2020.0, 3.0), (2020.0, 2.0), (2021.0, 1.0), (2020.0, 2.0), (2020.0, NA), (NA, NA))
    out = y.mutate(r=f.min_rank("y", "m"), t=f.ntile(2, "y", "m"))
    assert values(out, "r") == [3, 1, 4, 1, NA, NA] and values(out, "t") == [2, 1, 2, 1, NA, NA]
    i = frame(spark, "id int, x int", (1, 1), (1, 2), (2, 3), (2, 4), (2, 5))
    assert values(i.group_by("id").mutate(t=f.ntile(2)), "t") == [1, 2, 1, 1, 2]
    assert values(i.mutate(t=f.ntile(4)), "t") == [1, 1, 2, 3, 4]
    assert values(i.mutate(v=f.lead("x")), "v") == [2, 3, 4, 5, NA] and values(i.mutate(v=f.lag("x", 9)), "v") == [NA] * 5
    assert values(i.mutate(v=f.lag("x", default=0)), "v") == [0, 1, 2, 3, 4] and values(i.mutate(v=f.lag("x", order_by=-col("x"))), "v") == [2, 3, 4, 5, NA]
    assert values(i.mutate(v=f.cumsum("x")), "v") == [1, 3, 6, 10, 15] and values(i.group_by("id").mutate(v=f.cumprod("x")), "v") == [1, 2, 3, 12, 60]
    assert values(i.mutate(v=f.with_order(-col("x"), f.cumsum, "x")), "v") == [15, 14, 12, 9, 5]
    b = frame(spark, "a boolean, i int", (True, 1), (NA, 2), (True, 3), (False, 4), (True, 5))
    assert values(b.mutate(v=f.cumall("a")), "v") == [True, NA, NA, False, False] and values(b.mutate(v=f.cumany(~col("a"))), "v") == [False, NA, NA, True, True]
    c = frame(spark, "x double, y int", (1.0, 1), (1.0, 2), (2.0, 2), (1.0, 1), (2.0, NA), (2.0, NA))
    assert values(c.mutate(v=f.consecutive_id("x")), "v") == [1, 1, 2, 3, 4, 4] and values(c.mutate(v=f.consecutive_id("x", "y")), "v") == [1, 2, 3, 4, 5, 5]
    assert values(c.mutate(v=f.cummean("y")), "v") == [1, 1.5, 5 / 3, 1.5, NA, NA]
    assert values(i.mutate(v=f.diff("x")), "v") == [NA, 1, 1, 1, 1]


def test_rowwise(spark):
    x = frame(spark, "g int, a int, b int", (1, 1, 2), (1, 3, 4))
    out = x.rowwise("g").summarise(s=f.row_sums("a", "b"))
    assert rows(out) == [(1, 3), (1, 7)] and out.groups == ("g",)
    assert values(x.rowwise().mutate(m=f.mean("a"), n=f.n()), "m") == [1.0, 3.0]
    with pytest.raises(ValueError):
        x.group_by("g").rowwise("a")


def test_conditionals(spark):
    x = frame(spark, "x int, b boolean, s string, d double", (1, True, "a", 0.0), (2, NA, "b", 1.0), (3, False, "c", NAN), (NA, True, NA, NA))
    v = lambda e: values(x.mutate(v=e), "v")
    assert v(f.case_when((col("x") <= 1, 1), (col("x") <= 2, 2), (f.is_na("x"), 0))) == [1, 2, NA, 0]
    assert v(f.case_when((col("x") <= 1, "l"), default="h")) == ["l", "h", "h", "h"]
    assert v(f.if_else(col("b"), -1, 1)) == [-1, NA, 1, -1] and v(f.if_else(col("b"), "t", "f", "m")) == ["t", "m", "f", "t"]
    assert v(f.replace_when("x", (col("x") == 2, 20))) == [1, 20, 3, NA] and v(f.coalesce("d", 9.0)) == [0.0, 1.0, 9.0, 9.0]
    assert v(f.na_if("x", 2)) == [1, NA, 3, NA] and v(f.na_if("d", NAN)) == [0.0, 1.0, NA, NA] and v(f.between("x", 2, 3.5)) == [False, True, True, NA]
    assert v(f.recode_values("s", ("a", "A"), (["b", "c"], "B"), (NA, "?"))) == ["A", "B", "B", "?"]
    assert v(f.recode_values("s", from_=["a", "b"], to=["A", "B"], default="-")) == ["A", "B", "-", "-"]
    assert v(f.replace_values("s", from_=["a", NA], to=["A", "?"])) == ["A", "b", "c", "?"] and v(f.case_match("x", ([1, 2], "lo"), default="hi")) == ["lo", "lo", "hi", "hi"]
    assert v(f.recode("s", {"a": "A"}, missing="?")) == ["A", "b", "c", "?"] and v(f.recode("s", {"a": "A"}, default="-")) == ["A", "-", "-", NA]
    assert v(f.near(col("d") + 1e-9, col("d"))) == [True, True, False, NA] and v(f.near(col("d") + 1e-6, col("d")))[:2] == [False, False]
    for bad in (f.if_else(col("b"), 1, "a"), f.coalesce("x", "s"), f.replace_when("x", (col("b"), "q")), f.na_if("x", "a")):
        with pytest.raises(TypeError):
            x.mutate(v=bad)
    with pytest.raises(Exception, match="no case"):
        x.mutate(v=f.case_when((col("x") == 1, 1), unmatched="error")).collect()
    grid = frame(spark, "a boolean, b boolean", *[(a, b) for a in (True, False, NA) for b in (True, False, NA)])
    g = lambda e: values(grid.mutate(v=e), "v")
    assert g(f.when_any("a", "b")) == [True, True, True, True, False, NA, True, NA, NA] and g(f.when_all("a", "b")) == [True, False, NA, False, False, False, NA, False, NA]
    assert g(f.when_any("a", "b", na_rm=True)) == [True, True, True, True, False, False, True, False, False] and g(f.xor("a", "b"))[:2] == [False, True]
    assert v(f.pmin("x", 2)) == [1, 2, 2, NA] and v(f.pmax("x", 2, na_rm=True)) == [2, 2, 3, 2] and v(f.paste("s", "x", sep="-")) == ["a-1", "b-2", "c-3", "NA-NA"]
    assert v(f.round(col("x") / 2)) == [0.0, 1.0, 2.0, NA] and v(f.cut("x", [0, 1, 3])) == ["(0,1]", "(1,3]", "(1,3]", NA] and v(col("s").isin("a", NA)) == [True, False, False, True]


def test_c_across(spark):
    from verbspark import c_across

    x = frame(spark, "g string, a int, b int, c int", ("u", 1, 5, 3), ("v", 9, 2, 4))
    assert values(x.rowwise("g").mutate(top=f.fn("array_max", c_across(["a", "b", "c"]))), "top") == [5, 9]
    assert values(x.group_by("g").mutate(n=f.fn("size", c_across())), "n") == [3, 3]
