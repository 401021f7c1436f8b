import pandas as pd
import pytest

from tests.helpers import NA, frame, rows, values
from verbspark import col, functions as f
from verbspark.sources import band_instruments, band_instruments2, band_members, copy_to, from_pandas, read, src_tbls, tbl, tibble, tribble
from verbspark.sources.tables import analyze, drop_table, same_src, write, write_table
from verbspark.streaming import StreamFrame, stream_from, windowed


def test_set_operations(spark):
    x, y = frame(spark, "x int, y double", (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)), frame(spark, "y double, x double", (1.0, 4.0), (1.0, 2.0))
    assert sorted(values(x.intersect(y), "x")) == [2, 4] and sorted(values(x.setdiff(y), "x")) == [1, 3] and sorted(values(x.symdiff(y), "x")) == [1, 3]
    assert sorted(values(x.union(y), "x")) == [1, 2, 3, 4] and values(x.union_all(y), "x") == [1, 2, 3, 4, 4, 2]
    d, e = frame(spark, "x int", 1, 1, 2, NA, NA), frame(spark, "x int", 2)
    assert sorted(map(str, values(d.union(e), "x"))) == ["1", "2", "None"] and sorted(map(str, values(d.setdiff(e), "x"))) == ["1", "None"]
    assert d.setequal(d.distinct()) and not d.setequal(e) and d.all_equal(d) and not d.all_equal(d.distinct())
    with pytest.raises(ValueError):
        x.union(e)
    with pytest.raises(TypeError):
        e.union(frame(spark, "x string", "a"))


def test_binding(spark):
    a, b = frame(spark, "x double", 1.0), frame(spark, "y double", 2.0)
    assert rows(a.bind_rows(b)) == [(1, NA), (NA, 2)] and rows(a.bind_rows([a, b], _id="t")) == [("1", 1, NA), ("2", 1, NA), ("3", NA, 2)]
    assert rows(a.arrange("x").bind_rows(frame(spark, "x double", 3.0, 0.0))) == [(1,), (3,), (0,)] and rows(a.add_row(x=5.0)) == [(1,), (5,)]
    assert rows(a.bind_cols(b, a)) == [(1, 2, 1)] and a.bind_cols(a).columns == ["x", "x...2"]
    with pytest.raises(ValueError):
        a.bind_cols(frame(spark, "z int", 1, 2))


def test_row_mutations(spark):
    x = frame(spark, "a int, b string, c double", (1, "a", 0.5), (2, "b", 1.5), (3, NA, 2.5))
    assert rows(x.rows_insert(frame(spark, "a int, b string", (4, "z")), "a"))[-1] == (4, "z", NA)
    with pytest.raises(ValueError):
        x.rows_insert(frame(spark, "a int, b string", (3, "z")), "a")
    assert len(rows(x.rows_insert(frame(spark, "a int, b string", (3, "z"), (4, "y")), "a", conflict="ignore"))) == 4
    assert len(rows(x.rows_append(frame(spark, "a int", 3)))) == 4
    y = frame(spark, "a int, b string", (2, NA), (3, "z"))
    assert rows(x.rows_update(y, "a")) == [(1, "a", 0.5), (2, NA, 1.5), (3, "z", 2.5)] and rows(x.rows_patch(y, "a")) == [(1, "a", 0.5), (2, "b", 1.5), (3, "z", 2.5)]
    more = frame(spark, "a int, b string", (3, "z"), (9, "q"))
    with pytest.raises(ValueError):
        x.rows_update(more, "a")
    assert rows(x.rows_update(more, "a", unmatched="ignore"))[2] == (3, "z", 2.5) and rows(x.rows_upsert(more, "a"))[2:] == [(3, "z", 2.5), (9, "q", NA)]
    assert rows(x.rows_delete(frame(spark, "a int, q int", (1, 1), (1, 2)), "a")) == [(2, "b", 1.5), (3, NA, 2.5)]
    for bad in (lambda: x.rows_delete(more, "a"), lambda: x.rows_update(frame(spark, "a int, b string", (1, "p"), (1, "q")), "a"), lambda: x.rows_append(frame(spark, "zz int", 1))):
        with pytest.raises(ValueError):
            bad()


def test_sources(spark, tmp_path):
    assert rows(band_members(spark).inner_join(band_instruments2(spark), {"name": "artist"})) == [("John", "Beatles", "guitar"), ("Paul", "Beatles", "bass")]
    assert len(rows(band_members(spark).full_join(band_instruments(spark), "name"))) == 4
    x = tibble(spark, "a int, b string", a=[1, 2, 3], b=["z"])
    assert rows(x) == [(1, "z"), (2, "z"), (3, "z")] and rows(tribble(spark, "a int, b string", 1, "x", 2, "y")) == [(1, "x"), (2, "y")]
    for kind in ("parquet", "json", "orc", "csv"):
        write(x, f"{tmp_path}/{kind}", kind)
        back = read(spark, f"{tmp_path}/{kind}", kind, schema="a int, b string")
        assert sorted(rows(back)) == rows(x)
    write(x, f"{tmp_path}/by", partition_by=("b",))
    assert read(spark, f"{tmp_path}/by").columns == ["a", "b"] and values(read(spark, f"{tmp_path}/parquet").mutate(r=f.row_number()).filter(col("r") == 1), "r") == [1]
    copied = copy_to(spark, pd.DataFrame({"k": [1, 2], "s": ["u", None]}), "copied_view", overwrite=True)
    assert rows(copied) == [(1, "u"), (2, NA)] and "copied_view" in src_tbls(spark) and len(tbl(spark, "copied_view").collect()) == 2 and same_src(copied, x)
    with pytest.raises(ValueError):
        copy_to(spark, copied, "copied_view")
    drop_table(spark, "verbs_saved")
    write_table(x, "verbs_saved", bucket_by=(2, "a"))
    analyze(spark, "verbs_saved")
    assert tbl(spark, "verbs_saved").dim_desc() == "[3 x 2]" and x.compute().collect() == x.collect()
    drop_table(spark, "verbs_saved")
    assert rows(from_pandas(spark, pd.DataFrame({"d": [1.5, float("nan")]}))) == [(1.5,), (NA,)]


def test_streams(spark, tmp_path):
    events = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(events).schema
    spark.read.parquet(events).write.parquet(f"{tmp_path}/in")
    s = stream_from(spark, f"{tmp_path}/in", schema).filter(col("value") > 0).mutate(double=col("value") * 2).select("ts", "event_type", "double")
    for bad in (lambda: s.arrange("ts"), lambda: s.mutate(m=f.mean("double")), lambda: s.filter(f.row_number() < 3)):
        with pytest.raises((ValueError, AttributeError)):
            bad()
    out = windowed(s, "ts", "1 day", "1 hour", ("event_type",), n=f.n(), total=f.sum("double"))
    q = out.writeStream.outputMode("complete").format("memory").queryName("verb_stream").start()
    try:
        q.processAllAvailable()
        got = spark.sql("SELECT sum(n) FROM verb_stream").first()[0]
    finally:
        q.stop()
    assert got == spark.read.parquet(events).where("value > 0").count()
    with pytest.raises(ValueError):
        StreamFrame(spark.range(1))
