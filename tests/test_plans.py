"""Plans that no single task stands in the way of, and verbs that depend on them."""

import datetime
import decimal
import random
import warnings

import pytest

from tests.helpers import NA, frame, rows, values
from verbspark import across, col, cur_column, desc, functions as f, join_by
from verbspark.operators import groups as G
from verbspark.operators import rows as R
from verbspark.sources import create_table, data_type, has_table, insert_into, is_tbl, lst, query_fields, query_rows, read, save_query, sql, tbl

DATA = "/root/testdata/sf0.01"


def whole_windows(df):
    """What the windows without partition keys of a plan read: the first node below that is no mere projection."""
    out = []

    def walk(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window" and node.partitionSpec().isEmpty():
            below = children[0]
            while below.nodeName() in ("Project", "Filter", "Sort", "Window"):
                below = below.children().head()
            out.append(below.nodeName())
        for child in children:
            walk(child)

    walk(df._jdf.queryExecution().optimizedPlan())
    return out


def test_no_window_sees_the_whole_table(spark):
    orders, events = read(spark, f"{DATA}/orders.parquet"), read(spark, f"{DATA}/events.parquet")
    down = orders.arrange(desc("o_orderdate"), desc("o_orderstatus"), desc("o_totalprice"), "o_orderkey")
    for frame_ in (
        down.group_by("o_custkey").summarise(a=f.first("o_orderkey"), b=f.last("o_orderkey")),
        down.bind_rows(down),
        orders.slice_sample(100, seed=1),
        orders.slice_head(5),
        orders.slice_min("o_totalprice", 3, with_ties=False),
    ):
        assert whole_windows(frame_.df) == []
    near = events.select("event_id").mutate(v=col("event_id") * 2).left_join(events.select(other="event_id"), join_by("closest(v >= other)"))
    assert set(whole_windows(near.df)) == {"Aggregate"}  # a row per range
    assert set(whole_windows(orders.slice_sample(prop=0.5, seed=1).df)) == {"Aggregate"}  # a row per bin
    assert set(whole_windows(orders.group_by("o_custkey").mutate(g=f.cur_group_id()).df)) == {"Aggregate"}  # a row per sorted part


@pytest.mark.parametrize("by", ["closest(x >= y)", "closest(x > y)", "closest(x <= y)", "closest(x < y)"])
def test_nearest_without_an_equality(spark, by):
    rng = random.Random(by)
    xs = [rng.choice((NA, *range(50))) for _ in range(200)]
    ys = [rng.choice((NA, *range(0, 50, 3))) for _ in range(30)]
    x = frame(spark, "i int, x int", *enumerate(xs))
    y = frame(spark, "j int, y double", *[(j, None if v is None else float(v)) for j, v in enumerate(ys)])
    test = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}[by.split()[1]]
    best = max if by.split()[1][0] == ">" else min
    expected = []
    for i, a in enumerate(xs):
        fits = [b for b in ys if a is not None and b is not None and test(a, b)]
        found = [j for j, b in enumerate(ys) if fits and b == best(fits)]
        expected += [(i, j) for j in found or [None]]
    got = rows(x.left_join(y, join_by(by), na_matches="never").select("i", "j"))
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_nearest_of_dates_and_of_nothing(spark):
    day = lambda k: datetime.date(2024, 1, k)
    x, y = frame(spark, "d date", day(5), day(1), NA), frame(spark, "e date", day(2), day(4))
    assert sorted(map(str, rows(x.left_join(y, join_by("closest(d >= e)"))))) == sorted(map(str, [(day(5), day(4)), (day(1), None), (None, None)]))
    assert rows(x.left_join(y.filter(col("e") > day(9)), join_by("closest(d >= e)")).select("e")) == [(None,)] * 3


@pytest.mark.parametrize("limit", [100_000, 0])
def test_samples_of_a_whole_table(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "LIMIT_ROWS", limit)
    x = frame(spark, "i int, w double", *[(i, float(i % 3)) for i in range(300)])
    for given, n in (({"n": 17}, 17), ({"n": 1000}, 300), ({"prop": 0.25}, 75), ({"n": -10}, 290), ({"n": 0}, 0), ({}, 1)):
        drawn = values(x.slice_sample(**given, seed=4), "i")
        assert len(drawn) == len(set(drawn)) == n and set(drawn) <= set(range(300))
    assert all(i % 3 for i in values(x.slice_sample(200, weight_by="w", seed=1), "i"))
    means = [sum(values(x.slice_sample(30, seed=s), "i")) / 30 for s in range(4)]
    assert len(set(means)) > 1 and all(90 < m < 210 for m in means)


@pytest.mark.parametrize("kind, items", [
    ("int", [3, -1, 2147483647, -2147483648]), ("double", [0.5, -2.0, 3e300]), ("string", ["a", "ab", "b", "", "é"]), ("boolean", [True, False]), ("date", [datetime.date(1960, 1, 1), datetime.date(2020, 5, 5)]),
    ("timestamp_ntz", [datetime.datetime(2020, 1, 1), datetime.datetime(1999, 1, 1)]), ("decimal(10,2)", [decimal.Decimal(1), decimal.Decimal(-5)]), ("array<int>", [[1, 2], [3]]),
])
def test_ends_after_a_descending_order(spark, kind, items):
    x = frame(spark, f"i int, k {kind}", *enumerate([*items, NA])).arrange(desc("k"))
    top = values(x.summarise(a=f.first("i"), b=f.last("i"), c=f.nth("i", 2)), "a")[0]
    assert [items[top]] == [max(items)]
    assert values(x.summarise(b=f.last("i")), "b") == [len(items)]


def test_group_numbers(spark):
    rng = random.Random(3)
    data = [(rng.choice((NA, *range(40))), rng.choice("abc")) for _ in range(500)]
    x = frame(spark, "k int, s string", *data).group_by("k", "s").mutate(g=f.cur_group_id())
    order = {key: n for n, key in enumerate(sorted(set(data), key=lambda t: (t[0] is None, t)), 1)}
    assert rows(x.ungroup()) == [(*t, order[t]) for t in data]


def test_many_to_many_warning(spark):
    x, y = frame(spark, "k int", 1, 1, 2), frame(spark, "k int, v int", (1, 1), (1, 2), (3, 3))
    with pytest.warns(UserWarning, match="many-to-many"):
        x.left_join(y, "k", relationship="warn-many-to-many")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        x.left_join(y.filter(col("v") != 2), "k", relationship="warn-many-to-many")
        x.left_join(y, "k")
    assert len(x.left_join(y, "k", relationship="many-to-many").collect()) == 5


def test_limits_of_results_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(G, "DRIVER_GROUPS", 3)
    x = frame(spark, "k int", 1, 2, 3, 4).group_by("k")
    for verb in (x.group_size, x.group_rows, x.group_split):
        with pytest.raises(ValueError, match="more than 3 groups"):
            verb()
    assert x.ungroup().filter(col("k") < 4).group_by("k").group_size() == [1, 1, 1]


def test_order_by_and_cur_column(spark):
    x = frame(spark, "t int, v int", (3, 1), (1, 10), (2, 100))
    out = x.mutate(a=f.order_by("t", f.cumsum("v")), b=f.order_by(desc("t"), f.lag("v")), c=f.order_by("t", f.consecutive_id("v")))
    assert rows(out.select("a", "b", "c")) == [(111, NA, 3), (10, 100, 1), (110, 1, 2)]
    assert rows(x.summarise(a=f.order_by("t", f.first("v")))) == [(10,)]
    with pytest.raises(TypeError):
        f.order_by("t", f.mean("v"))
    assert rows(x.filter(col("t") == 1).mutate(across(["t", "v"], lambda c: f.paste(cur_column(), c)))) == [("t 1", "v 10")]
    with pytest.raises(ValueError):
        x.mutate(a=cur_column()).collect()


def test_tables_and_queries(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS verbspark_t")
    spark.sql(f"CREATE TABLE verbspark_t (b STRING, a INT) USING parquet LOCATION '{tmp_path}/t'")
    x = frame(spark, "a int, b string", (1, "x"), (2, NA))
    insert_into(x, "verbspark_t")
    assert has_table(spark, "verbspark_t") and not has_table(spark, "verbspark_none")
    assert query_fields(spark, "verbspark_t") == ["b", "a"] and query_rows(spark, "verbspark_t") == 2 and query_rows(spark, sql("SELECT 1 LIMIT 0")) == 0
    assert sorted(map(str, rows(tbl(spark, sql("SELECT a FROM verbspark_t"))))) == ["(1,)", "(2,)"]
    assert rows(save_query(spark, "SELECT 5 AS k", "verbspark_v")) == [(5,)]
    spark.sql("DROP TABLE verbspark_t")
    assert data_type(x) == {"a": "int", "b": "string"} and is_tbl(x) and not is_tbl(x.df) and callable(create_table)
    assert x.type_sum() == {"a": "int", "b": "chr"} and x.factor("b").type_sum()["b"] == "fct"
    assert lst(a=1, b=lambda own: own["a"] + 1) == {"a": 1, "b": 2}


def test_plain_equality_where_a_key_is_never_missing(spark):
    x = spark.range(5).withColumnRenamed("id", "k")
    y = frame(spark, "k long", 1, NA)
    joined = tbl(x).inner_join(y, "k")
    assert "<=>" not in joined.show_query() and rows(joined) == [(1,)]
    assert "<=>" in y.inner_join(y, "k").show_query()
