"""A query per operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    across, all_of, all_vars, any_of, any_vars, c_across, col, common_by, contains, cur_column, desc, ends_with, everything, functions as f, group_cols, if_all, if_any, is_character, is_numeric, join_by,
    last_col, matches, num_range, one_of, pick, span, starts_with, vars_, where,
)
from .frame import Frame
from .plans.expr import Expr, named
from .sources import band_instruments, band_instruments2, band_members, copy_to, data_type, from_rows, has_table, lst, query_fields, read, same_src, sql, tbl, tibble, tribble

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as frames, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> Frame:
        return read(self.spark, f"{self._dir}/{name}.parquet")

    def answers(self, **given: Any) -> Frame:
        """Results that are no tables as rows of (name, answer)."""
        return from_rows(self.spark, [(name, str(value)) for name, value in given.items()], "name string, answer string")


def query(name: str, text: str | None = None):
    """Registers a function of the tables, with the SQL for its rows."""

    def register(function: Callable[[Tables], Frame]) -> Callable[[Tables], Frame]:
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir)).df
        if text is not None:
            SQL[name] = text
        return function

    return register


def rounded(x: Any, digits: int = 2) -> Expr:
    return Expr("rounded", (named(x),), lambda c, v: F.round(v, digits))


def events(t: Tables) -> Frame:
    """Events in an order that does not depend on files."""
    return t.events.arrange("event_id")


# flagship queries


@query(
    "q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def q1_pricing_summary(t: Tables) -> Frame:
    return (
        t.lineitem.filter(col("l_shipdate") <= datetime(1998, 9, 2))
        .mutate(disc=col("l_extendedprice") * (1 - col("l_discount")))
        .mutate(charge=col("disc") * (1 + col("l_tax")))
        .group_by("l_returnflag", "l_linestatus")
        .summarise(
            sum_qty=f.sum("l_quantity"), sum_base=rounded(f.sum("l_extendedprice")), sum_disc=rounded(f.sum("disc")), sum_charge=rounded(f.sum("charge")),
            avg_qty=rounded(f.mean("l_quantity"), 4), n=f.n(),
        )
        .arrange("l_returnflag", "l_linestatus")
    )


@query(
    "q3_shipping_priority",
    """SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10""",
)
def q3_shipping_priority(t: Tables) -> Frame:
    day = datetime(1998, 3, 15)
    orders = t.orders.filter(col("o_orderdate") < day).semi_join(t.customer.filter(col("c_mktsegment") == "BUILDING"), {"o_custkey": "c_custkey"})
    revenue = t.lineitem.filter(col("l_shipdate") > day).mutate(revenue=col("l_extendedprice") * (1 - col("l_discount")))
    return (
        orders.select("o_orderkey", "o_orderdate").inner_join(revenue.select("l_orderkey", "revenue"), {"o_orderkey": "l_orderkey"})
        .group_by("o_orderkey", "o_orderdate").summarise(revenue=rounded(f.sum("revenue")), _groups="drop").arrange(desc("revenue"), "o_orderkey").slice_head(10)
    )


@query(
    "q5_local_supplier",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
)
def q5_local_supplier(t: Tables) -> Frame:
    nations = t.nation.inner_join(t.region.filter(col("r_name") == "ASIA"), {"n_regionkey": "r_regionkey"})
    return (
        t.lineitem.inner_join(t.orders, {"l_orderkey": "o_orderkey"}).inner_join(t.customer, {"o_custkey": "c_custkey"})
        .inner_join(t.supplier, {"l_suppkey": "s_suppkey", "c_nationkey": "s_nationkey"}).inner_join(nations, {"c_nationkey": "n_nationkey"})
        .mutate(revenue=col("l_extendedprice") * (1 - col("l_discount"))).group_by("n_name").summarise(revenue=rounded(f.sum("revenue")))
    )


def _all() -> None:
    """The other queries: name, function, SQL."""
    for name, function, text in (
        # columns
        ("select", lambda t: t.customer.select("c_name", key="c_custkey"), "SELECT c_name, c_custkey AS key FROM customer"),
        ("select_helpers", lambda t: t.part.select(starts_with("p_p") | ends_with("size"), contains("brand")), "SELECT p_partkey, p_size, p_brand FROM part"),
        ("rename", lambda t: t.nation.rename(nation="n_name"), "SELECT n_nationkey, n_name AS nation, n_regionkey FROM nation"),
        ("rename_with", lambda t: t.nation.rename_with(str.upper, contains("key")), "SELECT n_nationkey AS N_NATIONKEY, n_name, n_regionkey AS N_REGIONKEY FROM nation"),
        ("relocate", lambda t: t.nation.relocate("n_regionkey", _before="n_nationkey"), "SELECT n_regionkey, n_nationkey, n_name FROM nation"),
        ("mutate", lambda t: t.part.mutate(double=col("p_size") * 2, more=col("double") + 1, p_name=None).select("p_partkey", "double", "more"), "SELECT p_partkey, p_size * 2 AS double, p_size * 2 + 1 AS more FROM part"),
        ("mutate_grouped", lambda t: t.supplier.group_by("s_nationkey").mutate(away=rounded(col("s_acctbal") - f.mean("s_acctbal"), 3)).ungroup().select("s_suppkey", "away"), "SELECT s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey), 3) AS away FROM supplier"),
        ("mutate_whole_table", lambda t: t.part.mutate(big=col("p_size") > f.mean("p_size")).select("p_partkey", "big"), "SELECT p_partkey, p_size > (SELECT avg(p_size) FROM part) AS big FROM part"),
        ("mutate_keep_used", lambda t: t.part.mutate(label=f.paste("p_brand", "p_type", sep="/"), _keep="used"), "SELECT p_brand, p_type, p_brand || '/' || p_type AS label FROM part"),
        ("transmute", lambda t: t.customer.transmute(key=col("c_custkey") + 1), "SELECT c_custkey + 1 AS key FROM customer"),
        ("pull", lambda t: tibble(t.spark, "n_name string", n_name=t.nation.pull("n_name")), "SELECT n_name FROM nation"),
        ("pick", lambda t: t.orders.distinct(pick(contains("status"), contains("priority"))), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
        ("across", lambda t: t.lineitem.group_by("l_returnflag").summarise(across(["l_quantity", "l_linenumber"], {"lo": f.min, "hi": f.max})), "SELECT l_returnflag, min(l_quantity) AS l_quantity_lo, max(l_quantity) AS l_quantity_hi, min(l_linenumber) AS l_linenumber_lo, max(l_linenumber) AS l_linenumber_hi FROM lineitem GROUP BY 1"),
        ("across_mutate", lambda t: t.nation.mutate(across(where(is_numeric), lambda v: v + 1)), "SELECT n_nationkey + 1 AS n_nationkey, n_name, n_regionkey + 1 AS n_regionkey FROM nation"),
        # filters
        ("filter", lambda t: t.lineitem.filter(col("l_quantity") > 45, col("l_discount") < 0.02).select("l_orderkey", "l_linenumber", "l_quantity"), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02"),
        ("filter_grouped", lambda t: t.supplier.filter(col("s_acctbal") > f.mean("s_acctbal"), _by="s_nationkey").select("s_suppkey"), "SELECT s_suppkey FROM supplier QUALIFY s_acctbal > avg(s_acctbal) OVER (PARTITION BY s_nationkey)"),
        ("filter_out", lambda t: t.lineitem.mutate(d=f.na_if("l_discount", 0.0)).filter_out(col("d") > 0.05).summarise(n=f.n()), "SELECT count(*) AS n FROM lineitem WHERE NOT coalesce(nullif(l_discount, 0) > 0.05, false)"),
        ("if_any", lambda t: t.part.filter(if_any(["p_size", "p_retailprice"], lambda v: v > 1000)).count(), "SELECT count(*) AS n FROM part WHERE p_size > 1000 OR p_retailprice > 1000"),
        ("if_all", lambda t: t.part.filter(if_all(["p_size", "p_retailprice"], lambda v: v > 20)).count(), "SELECT count(*) AS n FROM part WHERE p_size > 20 AND p_retailprice > 20"),
        ("between", lambda t: t.part.filter(f.between("p_size", 10, 20)).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20"),
        ("near", lambda t: t.part.filter(f.near(col("p_retailprice"), 900.1)).select("p_partkey"), "SELECT p_partkey FROM part WHERE abs(p_retailprice - 900.1) < 1.4901161193847656e-08"),
        ("when_any_all", lambda t: t.part.transmute(k=col("p_partkey"), a=f.when_any(col("p_size") > 40, col("p_type") == "ECONOMY"), e=f.when_all(col("p_size") > 40, col("p_type") == "ECONOMY")), "SELECT p_partkey AS k, p_size > 40 OR p_type = 'ECONOMY' AS a, p_size > 40 AND p_type = 'ECONOMY' AS e FROM part"),
        ("in_and_xor", lambda t: t.orders.filter(f.xor(col("o_orderstatus").isin("F"), col("o_custkey") > 700)).summarise(n=f.n()), "SELECT count(*) AS n FROM orders WHERE (o_orderstatus = 'F') <> (o_custkey > 700)"),
        # order, slices, samples
        ("arrange", lambda t: t.orders.arrange(desc("o_totalprice"), "o_orderkey").group_by("o_orderstatus").mutate(place=f.row_number(), top=f.first("o_orderkey")).ungroup().select("o_orderkey", "place", "top"), "SELECT o_orderkey, row_number() OVER w AS place, first_value(o_orderkey) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)"),
        ("slice", lambda t: events(t).slice(2, 5, _by="user_id").select("event_id"), "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) IN (2, 5)"),
        ("slice_head", lambda t: events(t).slice_head(3, _by="user_id").select("event_id"), "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3"),
        ("slice_tail", lambda t: events(t).slice_tail(prop=0.1, _by="user_id").select("event_id"), "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= floor(0.1 * count(*) OVER (PARTITION BY user_id))"),
        ("slice_min", lambda t: t.part.slice_min("p_retailprice", 2, _by="p_brand").select("p_partkey"), "SELECT p_partkey FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) <= 2"),
        ("slice_max", lambda t: t.orders.slice_max("o_totalprice", 15).select("o_orderkey"), "SELECT o_orderkey FROM orders QUALIFY rank() OVER (ORDER BY o_totalprice DESC) <= 15"),
        ("top_n", lambda t: t.customer.group_by("c_mktsegment").top_n(3, "c_acctbal").ungroup().select("c_custkey"), "SELECT c_custkey FROM customer QUALIFY rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) <= 3"),
        ("slice_sample", lambda t: _drawn(t.orders, t.orders.slice_sample(25, _by="o_orderstatus", seed=7), "o_orderkey", "o_orderstatus"), "SELECT o_orderstatus, least(count(*), 25) AS n, least(count(*), 25) AS known FROM orders GROUP BY 1"),
        ("slice_sample_share", lambda t: _drawn(t.events, t.events.slice_sample(prop=0.3, seed=3), "event_id"), "SELECT CAST(floor(0.3 * count(*)) AS BIGINT) AS n, CAST(floor(0.3 * count(*)) AS BIGINT) AS known FROM events"),
        ("slice_sample_replace", lambda t: t.nation.slice_sample(1000, replace=True, seed=7).semi_join(t.nation, "n_name").summarise(n=f.n(), fair=f.n_distinct("n_name") > 20), "SELECT 1000 AS n, true AS fair"),
        ("slice_sample_weighted", lambda t: t.part.slice_sample(40, weight_by=f.if_else(col("p_size") > 25, 1.0, 0.0), seed=7).summarise(n=f.n(), heavy=f.min("p_size") > 25, parts=f.n_distinct("p_partkey")), "SELECT 40 AS n, true AS heavy, 40 AS parts"),
        ("sample_n_frac", lambda t: _drawn(t.nation, t.nation.sample_n(5, seed=1), "n_name").bind_rows(_drawn(t.nation, t.nation.sample_frac(0.2, seed=1), "n_name")), "SELECT 5 AS n, 5 AS known UNION ALL SELECT 5, 5"),
        ("distinct", lambda t: t.lineitem.distinct("l_returnflag", "l_linestatus"), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
        ("distinct_keep_all", lambda t: events(t).distinct("user_id", "event_type", _keep_all=True).select("event_id", "user_id", "event_type"), "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY ALL"),
        # joins
        ("inner_join", lambda t: t.orders.inner_join(t.customer, {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name"), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
        ("left_join", lambda t: t.customer.left_join(t.orders.filter(col("o_totalprice") > 400000), {"c_custkey": "o_custkey"}).select("c_custkey", "o_orderkey"), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey"),
        ("right_join", lambda t: t.supplier.filter(col("s_acctbal") > 5000).right_join(t.nation, {"s_nationkey": "n_nationkey"}).select("s_suppkey", "s_nationkey", "n_name"), "SELECT s_suppkey, n_nationkey AS s_nationkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey"),
        ("full_join", lambda t: t.supplier.mutate(k=col("s_nationkey") * 2).full_join(t.nation, {"k": "n_nationkey"}).select("s_suppkey", "k", "n_name"), "SELECT s_suppkey, coalesce(s_nationkey * 2, n_nationkey) AS k, n_name FROM supplier FULL JOIN nation ON s_nationkey * 2 = n_nationkey"),
        ("semi_join", lambda t: t.customer.semi_join(t.orders, {"c_custkey": "o_custkey"}).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
        ("anti_join", lambda t: t.customer.anti_join(t.orders, {"c_custkey": "o_custkey"}).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
        ("nest_join", lambda t: t.nation.nest_join(t.supplier.select("s_suppkey", "s_nationkey"), {"n_nationkey": "s_nationkey"}, name="suppliers").unnest("suppliers").select("n_nationkey", "s_suppkey"), "SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey"),
        ("nest_join_sizes", lambda t: t.nation.nest_join(t.supplier, {"n_nationkey": "s_nationkey"}, name="suppliers").transmute(n_nationkey=col("n_nationkey"), n=f.fn("size", "suppliers")), "SELECT n_nationkey, CAST(count(s_suppkey) AS INTEGER) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1"),
        ("cross_join", lambda t: t.nation.cross_join(t.region).select("n_name", "r_name"), "SELECT n_name, r_name FROM nation CROSS JOIN region"),
        ("join_missing_keys", lambda t: t.nation.mutate(k=f.na_if("n_regionkey", 0)).inner_join(t.region.mutate(k=f.na_if("r_regionkey", 0)), "k").select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON nullif(n_regionkey, 0) IS NOT DISTINCT FROM nullif(r_regionkey, 0)"),
        ("join_missing_never", lambda t: t.nation.mutate(k=f.na_if("n_regionkey", 0)).inner_join(t.region.mutate(k=f.na_if("r_regionkey", 0)), "k", na_matches="never").select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON nullif(n_regionkey, 0) = nullif(r_regionkey, 0)"),
        ("join_inequality", lambda t: t.supplier.inner_join(t.nation, join_by("s_nationkey > n_nationkey")).count("s_suppkey"), "SELECT s_suppkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey > n_nationkey GROUP BY 1"),
        ("join_closest", lambda t: _purchases(t).left_join(_views(t), join_by("user_id", "closest(ts >= seen)")).select("event_id", "view_id"), "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"),
        ("join_closest_after", lambda t: _purchases(t).inner_join(_views(t), join_by("user_id", "closest(ts < seen)")).select("event_id", "view_id"), "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts < v.ts"),
        ("join_between", lambda t: _purchases(t).inner_join(_sessions(t), join_by("user_id", "between(event_id, first, last)")).select("event_id", "session"), "WITH s AS (SELECT user_id, event_id // 500 AS session, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY ALL) SELECT e.event_id, s.session FROM events e JOIN s ON e.user_id = s.user_id AND e.event_id BETWEEN s.first AND s.last WHERE event_type = 'purchase'"),
        ("join_overlaps", lambda t: _sessions(t).inner_join(_sessions(t).rename(a="first", b="last", other="session"), join_by("user_id", "overlaps(first, last, a, b)")).count("user_id"), "WITH s AS (SELECT user_id, event_id // 500 AS session, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY ALL) SELECT x.user_id, count(*) AS n FROM s x JOIN s y ON x.user_id = y.user_id AND x.first <= y.last AND x.last >= y.first GROUP BY 1"),
        ("join_within", lambda t: _sessions(t).inner_join(_sessions(t).mutate(a=col("first") - 100, b=col("last") + 100).select("user_id", "a", "b"), join_by("user_id", "within(first, last, a, b)")).count("user_id"), "WITH s AS (SELECT user_id, event_id // 500 AS session, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY ALL) SELECT x.user_id, count(*) AS n FROM s x JOIN s y ON x.user_id = y.user_id AND x.first >= y.first - 100 AND x.last <= y.last + 100 GROUP BY 1"),
        ("join_first_match", lambda t: t.customer.left_join(t.orders.arrange("o_orderkey"), {"c_custkey": "o_custkey"}, multiple="first").select("c_custkey", "o_orderkey"), "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
        ("join_contract", lambda t: t.orders.inner_join(t.customer, {"o_custkey": "c_custkey"}, relationship="many-to-one", unmatched=("error", "drop")).summarise(n=f.n()), "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey"),
        # groups
        ("group_keys", lambda t: t.part.group_by("p_brand", "p_type").group_keys(), "SELECT DISTINCT p_brand, p_type FROM part"),
        ("group_size", lambda t: t.part.group_by("p_brand").group_data().transmute(p_brand=col("p_brand"), n=f.fn("size", ".rows")), "SELECT p_brand, CAST(count(*) AS INTEGER) AS n FROM part GROUP BY 1"),
        ("group_indices", lambda t: t.orders.group_by("o_orderpriority").mutate(g=f.cur_group_id()).ungroup().select("o_orderkey", "g"), "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) AS g FROM orders"),
        ("group_nest", lambda t: t.nation.group_nest("n_regionkey").unnest("data"), "SELECT n_regionkey, n_nationkey, n_name FROM nation"),
        ("nest_by", lambda t: t.nation.nest_by("n_regionkey").ungroup().unnest("data"), "SELECT n_regionkey, n_nationkey, n_name FROM nation"),
        ("group_modify", lambda t: t.supplier.group_by("s_nationkey").group_modify(lambda d, key: d.nlargest(1, ["s_acctbal", "s_suppkey"])[["s_suppkey"]], "s_suppkey long").ungroup(), "SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) = 1"),
        ("with_groups", lambda t: t.part.with_groups("p_type", lambda g: g.summarise(n=f.n())), "SELECT p_type, count(*) AS n FROM part GROUP BY 1"),
        ("rowwise", lambda t: t.part.rowwise("p_partkey").summarise(m=f.row_sums("p_size", "p_partkey")).ungroup(), "SELECT p_partkey, p_size + p_partkey AS m FROM part"),
        ("c_across", lambda t: t.nation.rowwise("n_name").mutate(top=f.fn("array_max", c_across(where(is_numeric)))).ungroup().select("n_name", "top"), "SELECT n_name, greatest(n_nationkey, n_regionkey) AS top FROM nation"),
        ("c_array", lambda t: t.nation.mutate(top=f.fn("array_max", f.c_array("n_nationkey", "n_regionkey"))).select("n_name", "top"), "SELECT n_name, greatest(n_nationkey, n_regionkey) AS top FROM nation"),
        # aggregates
        ("summarise", lambda t: t.orders.group_by("o_orderstatus").summarise(n=f.n(), lo=f.min("o_totalprice"), hi=f.max("o_totalprice"), m=rounded(f.mean("o_totalprice"))), "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 2) AS m FROM orders GROUP BY 1"),
        ("summarise_by", lambda t: t.part.summarise(n=f.n(), size=f.sum("p_size"), _by=["p_brand", "p_type"]), "SELECT p_brand, p_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY ALL"),
        ("summarise_sequential", lambda t: t.part.group_by("p_type").summarise(p_size=f.max("p_size"), twice=col("p_size") * 2, again=f.sum("p_size")), "SELECT p_type, max(p_size) AS p_size, max(p_size) * 2 AS twice, max(p_size) AS again FROM part GROUP BY 1"),
        ("missing_propagates", lambda t: t.lineitem.mutate(d=f.na_if("l_discount", 0.1)).group_by("l_returnflag", "l_linestatus").summarise(m=f.sum("d"), k=rounded(f.sum("d", na_rm=True)), _groups="drop"), "SELECT l_returnflag, l_linestatus, CASE WHEN count(nullif(l_discount, 0.1)) = count(*) THEN round(sum(l_discount), 2) END AS m, round(sum(nullif(l_discount, 0.1)), 2) AS k FROM lineitem GROUP BY ALL"),
        ("statistics", lambda t: t.lineitem.group_by("l_returnflag").summarise(md=f.median("l_quantity"), s=rounded(f.sd("l_quantity"), 4), v=rounded(f.var("l_quantity"), 3), q=rounded(f.quantile("l_quantity", 0.9), 4), i=f.iqr("l_quantity"), a=rounded(f.mad("l_quantity"), 4)), "WITH m AS (SELECT *, median(l_quantity) OVER (PARTITION BY l_returnflag) AS md FROM lineitem) SELECT l_returnflag, median(l_quantity) AS md, round(stddev_samp(l_quantity), 4) AS s, round(var_samp(l_quantity), 3) AS v, round(quantile_cont(l_quantity, 0.9), 4) AS q, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS i, round(median(abs(l_quantity - md)) * 1.4826, 4) AS a FROM m GROUP BY 1"),
        ("any_all", lambda t: t.orders.group_by("o_custkey").summarise(a=f.any(col("o_totalprice") > 490000), e=f.all(col("o_totalprice") > 20000)), "SELECT o_custkey, bool_or(o_totalprice > 490000) AS a, bool_and(o_totalprice > 20000) AS e FROM orders GROUP BY 1"),
        ("n_distinct", lambda t: t.lineitem.group_by("l_returnflag").summarise(a=f.n_distinct("l_suppkey"), b=f.n_distinct("l_suppkey", "l_linenumber"), c=f.n_distinct(f.na_if("l_linenumber", 1)), d=f.n_distinct(f.na_if("l_linenumber", 1), na_rm=True)), "SELECT l_returnflag, count(DISTINCT l_suppkey) AS a, count(DISTINCT (l_suppkey, l_linenumber)) AS b, count(DISTINCT l_linenumber) AS c, count(DISTINCT nullif(l_linenumber, 1)) AS d FROM lineitem GROUP BY 1"),
        ("first_last_nth", lambda t: events(t).group_by("user_id").summarise(a=f.first("event_type"), b=f.last("value"), c=f.nth("event_id", 3), d=f.nth("event_id", -2), e=f.first("event_id", order_by=desc_value())), "SELECT user_id, arg_min(event_type, event_id) AS a, arg_max(value, event_id) AS b, max(CASE WHEN r = 3 THEN event_id END) AS c, max(CASE WHEN s = 2 THEN event_id END) AS d, max(CASE WHEN v = 1 THEN event_id END) AS e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS s, row_number() OVER (PARTITION BY user_id ORDER BY -value, event_id) AS v FROM events) GROUP BY 1"),
        ("count", lambda t: t.orders.count("o_orderstatus", "o_orderpriority"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL"),
        ("count_weighted", lambda t: t.lineitem.count("l_suppkey", _wt="l_quantity", _name="qty"), "SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1"),
        ("tally", lambda t: t.events.group_by("event_type").tally(), "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
        ("add_count", lambda t: t.customer.add_count("c_nationkey").select("c_custkey", "n"), "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer"),
        ("add_tally", lambda t: t.nation.add_tally().select("n_name", "n"), "SELECT n_name, count(*) OVER () AS n FROM nation"),
        ("count_empty_levels", lambda t: _leveled(t).count("event_type", _drop=False), "SELECT l.event_type, count(e.event_id) AS n FROM (SELECT unnest(['click', 'error', 'none', 'view']) AS event_type) l LEFT JOIN (SELECT * FROM events WHERE event_type IN ('click', 'error', 'view')) e USING (event_type) GROUP BY 1"),
        ("reframe", lambda t: t.part.reframe(q=f.c_array(f.min("p_size"), f.max("p_size")), k=f.c_array(0, 1), _by="p_brand"), "SELECT p_brand, min(p_size) AS q, 0 AS k FROM part GROUP BY 1 UNION ALL SELECT p_brand, max(p_size), 1 FROM part GROUP BY 1"),
        ("reframe_which", lambda t: events(t).group_by("user_id").reframe(place=f.which(col("event_type") == "error")), "SELECT user_id, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE event_type = 'error'"),
        ("approx_n_distinct", lambda t: t.lineitem.group_by("l_returnflag").summarise(k=f.approx_n_distinct("l_orderkey"), e=f.n_distinct("l_orderkey")).transmute(l_returnflag=col("l_returnflag"), near=f.between(col("k") / col("e"), 0.8, 1.2)), "SELECT DISTINCT l_returnflag, true AS near FROM lineitem"),
        ("cube", lambda t: t.orders.cube("o_orderstatus", "o_orderpriority", n=f.n()), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
        ("rollup", lambda t: t.orders.rollup("o_orderstatus", "o_orderpriority", n=f.n()), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
        # windows
        ("ranks", lambda t: t.part.group_by("p_type").mutate(a=f.min_rank("p_size"), b=f.dense_rank("p_size"), c=f.min_rank(desc("p_size"))).ungroup().select("p_partkey", "a", "b", "c"), "SELECT p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_size) AS a, dense_rank() OVER (PARTITION BY p_type ORDER BY p_size) AS b, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS c FROM part"),
        ("rank_shares", lambda t: t.part.group_by("p_type").mutate(p=rounded(f.percent_rank("p_size"), 6), q=rounded(f.cume_dist("p_size"), 6)).ungroup().select("p_partkey", "p", "q"), "SELECT p_partkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS q FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_size)"),
        ("row_number", lambda t: events(t).group_by("user_id").mutate(r=f.row_number(), s=f.row_number(desc("value"))).ungroup().select("event_id", "r", "s"), "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS s FROM events"),
        ("ntile", lambda t: events(t).group_by("user_id").mutate(b=f.ntile(4)).ungroup().select("event_id", "b"), "SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events"),
        ("lag_lead", lambda t: events(t).group_by("user_id").mutate(a=f.lag("event_type"), b=f.lead("event_id", 2, default=-1), d=rounded(f.diff("value"))).ungroup().select("event_id", "a", "b", "d"), "SELECT event_id, lag(event_type) OVER w AS a, lead(event_id, 2, -1) OVER w AS b, round(value - lag(value) OVER w, 2) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
        ("cumulative", lambda t: events(t).group_by("user_id").mutate(s=f.cumsum("event_id"), lo=f.cummin("value"), hi=f.cummax("value"), m=rounded(f.cummean("value"), 10)).ungroup().select("event_id", "s", "lo", "hi", "m"), "SELECT event_id, CAST(sum(event_id) OVER w AS BIGINT) AS s, min(value) OVER w AS lo, max(value) OVER w AS hi, round(avg(value) OVER w, 10) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
        ("cumulative_logic", lambda t: events(t).group_by("user_id").mutate(a=f.cumall(col("event_type") != "error"), b=f.cumany(col("event_type") == "purchase")).ungroup().select("event_id", "a", "b"), "SELECT event_id, bool_and(event_type <> 'error') OVER w AS a, bool_or(event_type = 'purchase') OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
        ("consecutive_id", lambda t: events(t).group_by("user_id").mutate(run=f.consecutive_id("event_type")).ungroup().select("event_id", "run"), "SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events)"),
        ("with_order", lambda t: events(t).group_by("user_id").mutate(s=f.with_order(-col("event_id"), f.cumsum, "event_id")).ungroup().select("event_id", "s"), "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS BIGINT) AS s FROM events"),
        # sets and binding
        ("union", lambda t: t.supplier.select(k="s_nationkey").union(t.customer.select(k="c_nationkey")), "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer"),
        ("union_all", lambda t: t.supplier.select(k="s_nationkey").union_all(t.customer.select(k="c_nationkey")), "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer"),
        ("intersect", lambda t: t.customer.select(k="c_custkey").intersect(t.orders.select(k="o_custkey")), "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders"),
        ("setdiff", lambda t: t.customer.select(k="c_custkey").setdiff(t.orders.select(k="o_custkey")), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"),
        ("symdiff", lambda t: t.part.select(k="p_size").symdiff(t.nation.select(k="n_nationkey")), "(SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation) UNION (SELECT n_nationkey FROM nation EXCEPT SELECT p_size FROM part)"),
        ("bind_rows", lambda t: t.nation.select("n_name").bind_rows(t.region.select("r_name"), _id="source"), "SELECT '1' AS source, n_name, NULL AS r_name FROM nation UNION ALL SELECT '2', NULL, r_name FROM region"),
        ("bind_cols", lambda t: t.nation.arrange("n_nationkey").select("n_name").bind_cols(t.nation.arrange(desc("n_nationkey")).select(other="n_name")), "SELECT n_name, other FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) JOIN (SELECT n_name AS other, row_number() OVER (ORDER BY n_nationkey DESC) AS r FROM nation) USING (r)"),
        # changes by key
        ("rows_insert", lambda t: t.nation.rows_insert(_changes(t), "n_nationkey", conflict="ignore"), "SELECT * FROM nation UNION ALL SELECT 30, 'NEW', 0"),
        ("rows_append", lambda t: t.nation.rows_append(_changes(t)), "SELECT * FROM nation UNION ALL SELECT n_nationkey, 'NEW', 0 FROM (SELECT unnest([1, 30]) AS n_nationkey)"),
        ("rows_update", lambda t: t.nation.rows_update(_changes(t), "n_nationkey", unmatched="ignore"), "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'NEW' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 1 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation"),
        ("rows_patch", lambda t: t.nation.mutate(n_name=f.na_if("n_name", "NATION_1")).rows_patch(_changes(t), "n_nationkey", unmatched="ignore"), "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'NEW' ELSE n_name END AS n_name, n_regionkey FROM nation"),
        ("rows_upsert", lambda t: t.nation.rows_upsert(_changes(t), "n_nationkey"), "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'NEW' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 1 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 30, 'NEW', 0"),
        ("rows_delete", lambda t: t.nation.rows_delete(_changes(t), "n_nationkey", unmatched="ignore"), "SELECT * FROM nation WHERE n_nationkey <> 1"),
        # conditionals and scalars
        ("if_else", lambda t: t.orders.transmute(o_orderkey=col("o_orderkey"), v=f.if_else(f.na_if("o_orderstatus", "P") == "F", "done", "open", "unknown")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'unknown' WHEN 'F' THEN 'done' ELSE 'open' END AS v FROM orders"),
        ("case_when", lambda t: t.part.transmute(p_partkey=col("p_partkey"), v=f.case_when((col("p_size") < 10, "s"), (col("p_size") < 30, "m"), default="l")), "SELECT p_partkey, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS v FROM part"),
        ("replace_when", lambda t: t.part.transmute(p_partkey=col("p_partkey"), v=f.replace_when("p_size", (col("p_size") > 40, 40))), "SELECT p_partkey, least(p_size, 40) AS v FROM part"),
        ("recode_values", lambda t: t.orders.transmute(o_orderkey=col("o_orderkey"), v=f.recode_values("o_orderstatus", ("F", "done"), (["O", "P"], "open"))), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS v FROM orders"),
        ("replace_values", lambda t: t.orders.transmute(o_orderkey=col("o_orderkey"), v=f.replace_values("o_orderstatus", from_=["F"], to=["X"])), "SELECT o_orderkey, replace(o_orderstatus, 'F', 'X') AS v FROM orders"),
        ("case_match", lambda t: t.nation.transmute(n_name=col("n_name"), v=f.case_match("n_regionkey", ([0, 1], "low"), default="high")), "SELECT n_name, CASE WHEN n_regionkey <= 1 THEN 'low' ELSE 'high' END AS v FROM nation"),
        ("recode", lambda t: t.orders.transmute(o_orderkey=col("o_orderkey"), v=f.recode("o_orderstatus", {"F": "X"}, default="other")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'X' ELSE 'other' END AS v FROM orders"),
        ("coalesce", lambda t: t.lineitem.mutate(v=f.coalesce(f.na_if("l_discount", 0.0), "l_tax", 0.5)).summarise(v=rounded(f.sum("v"), 1)), "SELECT round(sum(coalesce(nullif(l_discount, 0), l_tax, 0.5)), 1) AS v FROM lineitem"),
        ("na_if", lambda t: t.nation.transmute(n_name=col("n_name"), v=f.na_if("n_regionkey", 2)), "SELECT n_name, nullif(n_regionkey, 2) AS v FROM nation"),
        ("arithmetic", lambda t: t.part.transmute(p_partkey=col("p_partkey"), m=(col("p_size") - 25) % 7, d=(col("p_size") - 25) // 7, r=f.round(col("p_size") / 2), z=col("p_size") / 0), "SELECT p_partkey, CAST((p_size - 25) - 7 * floor((p_size - 25) / 7.0) AS BIGINT) AS m, CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS d, CAST(round_even(p_size / 2.0, 0) AS DOUBLE) AS r, CAST('infinity' AS DOUBLE) AS z FROM part"),
        ("row_minimum", lambda t: t.part.transmute(p_partkey=col("p_partkey"), lo=f.pmin("p_size", 20), hi=f.pmax("p_size", 20), c=f.cut("p_size", [0, 10, 30, 60])), "SELECT p_partkey, least(p_size, 20) AS lo, greatest(p_size, 20) AS hi, CASE WHEN p_size <= 10 THEN '(0,10]' WHEN p_size <= 30 THEN '(10,30]' ELSE '(30,60]' END AS c FROM part"),
        ("text_functions", lambda t: t.part.transmute(p_partkey=col("p_partkey"), u=f.upper("p_name"), g=f.grepl("ring$", "p_name")), "SELECT p_partkey, upper(p_name) AS u, regexp_matches(p_name, 'ring$') AS g FROM part"),
        # scoped forms and functions of pandas
        ("mutate_if", lambda t: t.nation.mutate_if(is_numeric, lambda v: v * 2), "SELECT n_nationkey * 2 AS n_nationkey, n_name, n_regionkey * 2 AS n_regionkey FROM nation"),
        ("summarise_at", lambda t: t.part.group_by("p_type").summarise_at(["p_size"], {"lo": f.min, "hi": f.max}), "SELECT p_type, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1"),
        ("filter_all", lambda t: t.nation.select("n_nationkey", "n_regionkey").filter_all(all_vars(lambda v: v > 1)), "SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey > 1 AND n_regionkey > 1"),
        ("filter_at", lambda t: t.nation.filter_at(["n_nationkey", "n_regionkey"], any_vars(lambda v: v == 2)), "SELECT * FROM nation WHERE n_nationkey = 2 OR n_regionkey = 2"),
        ("select_if", lambda t: t.nation.select_if(is_numeric, str.upper), "SELECT n_nationkey AS N_NATIONKEY, n_regionkey AS N_REGIONKEY FROM nation"),
        ("distinct_at", lambda t: t.part.distinct_at(["p_brand"]), "SELECT DISTINCT p_brand FROM part"),
        ("group_by_at", lambda t: t.part.group_by_at(["p_brand"]).tally(), "SELECT p_brand, count(*) AS n FROM part GROUP BY 1"),
        ("arrange_all", lambda t: t.region.arrange_all().mutate(place=f.row_number()), "SELECT *, row_number() OVER (ORDER BY r_regionkey, r_name) AS place FROM region"),
        ("pandas_aggregate", lambda t: t.part.group_by("p_type").summarise(v=f.pandas_agg(lambda s: float(s.max() - s.min()), "double", "p_size")), "SELECT p_type, CAST(max(p_size) - min(p_size) AS DOUBLE) AS v FROM part GROUP BY 1"),
        ("everything", lambda t: t.supplier.select("s_nationkey", everything()).select(1, last_col()).rename_with(str.upper, everything()), "SELECT s_nationkey AS S_NATIONKEY, s_acctbal AS S_ACCTBAL FROM supplier"),
        # where tables come from
        ("tbl_sql", lambda t: tbl(t.spark, sql("SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, NULL")).filter(~col("b").is_na()), "SELECT 1 AS a, 'x' AS b"),
        ("copy_to", lambda t: copy_to(t.spark, t.region, "verbspark_region", overwrite=True).bind_rows(tbl(t.spark, "verbspark_region")).count("r_name"), "SELECT r_name, 2 AS n FROM region"),
        ("catalog_reads", lambda t: t.answers(has=has_table(copy_to(t.spark, t.region, "verbspark_region", overwrite=True).session, "verbspark_region"), lacks=has_table(t.spark, "verbspark_no_such"), fields=",".join(query_fields(t.spark, sql("SELECT 1 AS a, 2 AS b"))), types=data_type(t.region.select(k="r_name"))["k"], same=same_src(t.region, t.nation)), "SELECT unnest(['has', 'lacks', 'fields', 'types', 'same']) AS name, unnest(['True', 'False', 'a,b', 'string', 'True']) AS answer"),
        ("compute", lambda t: t.part.filter(col("p_size") > 30).compute().collapse().count("p_brand"), "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 30 GROUP BY 1"),
        ("collect", lambda t: from_rows(t.spark, [tuple(r) for r in t.nation.collect()], t.nation.schema), "SELECT * FROM nation"),
        ("tribble_add_row", lambda t: tribble(t.spark, "a int, b string", 1, "x", 2, "y").add_row(a=3), "SELECT unnest([1, 2, 3]) AS a, unnest(['x', 'y', NULL]) AS b"),
        ("tibble_lst", lambda t: tibble(t.spark, "a int, b int", **lst(a=[1, 2, 3], b=lambda own: [len(own["a"])])), "SELECT unnest([1, 2, 3]) AS a, 3 AS b"),
        ("band_members", lambda t: band_members(t.spark).full_join(band_instruments(t.spark), "name").union(band_members(t.spark).full_join(band_instruments2(t.spark), {"name": "artist"})), "SELECT unnest(['Mick', 'John', 'Paul', 'Keith']) AS name, unnest(['Stones', 'Beatles', 'Beatles', NULL]) AS band, unnest([NULL, 'guitar', 'bass', 'guitar']) AS plays"),
        ("descriptions", lambda t: t.answers(dim=t.nation.dim_desc(), types=",".join(t.nation.type_sum().values()), vars=",".join(t.nation.group_by("n_regionkey").tbl_nongroup_vars()), all=",".join(t.nation.tbl_vars()), empty=t.nation.tbl_ptype().count(), glimpse=t.region.select("r_name").glimpse(1).splitlines()[0], plan="Relation" in t.region.show_query()), "SELECT unnest(['dim', 'types', 'vars', 'all', 'empty', 'glimpse', 'plan']) AS name, unnest(['[25 x 3]', 'int,chr,int', 'n_nationkey,n_name', 'n_nationkey,n_name,n_regionkey', '0', 'Columns: 1', 'True']) AS answer"),
        # selections
        ("select_by_names", lambda t: t.part.select(all_of(["p_size"]), any_of(["p_type", "p_none"]), one_of(["p_brand"]), span("p_partkey", "p_name")), "SELECT p_size, p_type, p_brand, p_partkey, p_name FROM part"),
        ("select_by_pattern", lambda t: t.nation.rename(n_1="n_nationkey", n_2="n_regionkey").select(num_range("n_", [1, 2]), matches("^n_na"), ends_with("zzz")), "SELECT n_nationkey AS n_1, n_regionkey AS n_2, n_name FROM nation"),
        ("group_cols", lambda t: t.part.group_by("p_brand").select(group_cols(), "p_size").ungroup(), "SELECT p_brand, p_size FROM part"),
        ("cur_column", lambda t: t.nation.mutate(across(["n_nationkey", "n_regionkey"], lambda v: f.paste(cur_column(), v, sep="="))), "SELECT 'n_nationkey=' || n_nationkey AS n_nationkey, n_name, 'n_regionkey=' || n_regionkey AS n_regionkey FROM nation"),
        # more of joins
        ("join_without_columns", lambda t: t.nation.select("n_name").cross_join(t.region.select("r_name")).semi_join(t.nation.select("n_name"), []), "SELECT n_name, r_name FROM nation CROSS JOIN region"),
        ("common_by", lambda t: t.answers(**{a: b for a, b in common_by({"n_regionkey": "r_regionkey"}, t.nation, t.region).items()}, **common_by(None, t.nation, t.nation.select("n_name"))), "SELECT unnest(['n_regionkey', 'n_name']) AS name, unnest(['r_regionkey', 'n_name']) AS answer"),
        ("join_missing_inequality", lambda t: t.nation.mutate(k=f.na_if("n_regionkey", 1)).inner_join(t.region.mutate(j=f.na_if("r_regionkey", 2)), join_by("k >= j")).select("n_name", "r_name"), "SELECT n_name, r_name FROM (SELECT *, nullif(n_regionkey, 1) AS k FROM nation) JOIN (SELECT *, nullif(r_regionkey, 2) AS j FROM region) ON k >= j OR (k IS NULL AND j IS NULL)"),
        ("join_missing_inequality_never", lambda t: t.nation.mutate(k=f.na_if("n_regionkey", 1)).inner_join(t.region.mutate(j=f.na_if("r_regionkey", 2)), join_by("k >= j"), na_matches="never").select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON nullif(n_regionkey, 1) >= nullif(r_regionkey, 2)"),
        ("join_keep", lambda t: t.nation.left_join(t.region.filter(col("r_name") != "ASIA"), {"n_regionkey": "r_regionkey"}, keep=True).select("n_name", "n_regionkey", "r_regionkey"), "SELECT n_name, n_regionkey, r_regionkey FROM nation LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey"),
        ("join_suffix", lambda t: t.nation.select(k="n_regionkey", name="n_name").inner_join(t.region.select(k="r_regionkey", name="r_name"), "k", suffix=("_nation", "_region")), "SELECT n_regionkey AS k, n_name AS name_nation, r_name AS name_region FROM nation JOIN region ON n_regionkey = r_regionkey"),
        ("join_key_type", lambda t: t.nation.mutate(k=col("n_regionkey").cast("int")).full_join(t.region.mutate(k=col("r_regionkey") + 0.5), "k").select("k", "n_name", "r_name"), "SELECT coalesce(CAST(n_regionkey AS DOUBLE), r_regionkey + 0.5) AS k, n_name, r_name FROM nation FULL JOIN region ON CAST(n_regionkey AS DOUBLE) = r_regionkey + 0.5"),
        ("join_grouped", lambda t: t.nation.group_by("n_regionkey").inner_join(t.supplier, {"n_nationkey": "s_nationkey"}).summarise(n=f.n()), "SELECT n_regionkey, count(*) AS n FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1"),
        ("join_last_match", lambda t: t.customer.left_join(t.orders.arrange("o_orderkey"), {"c_custkey": "o_custkey"}, multiple="last").select("c_custkey", "o_orderkey"), "SELECT c_custkey, max(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
        ("join_closest_alone", lambda t: _purchases(t).mutate(v=col("event_id") * 3).left_join(_views(t).select("view_id"), join_by("closest(v >= view_id)")).select("event_id", "view_id"), "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.event_id * 3 >= v.event_id"),
        ("join_closest_alone_after", lambda t: _purchases(t).left_join(_views(t).select("view_id"), join_by("closest(event_id < view_id)")).select("event_id", "view_id"), "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.event_id < v.event_id"),
        ("join_refused", lambda t: t.answers(many=_refused(lambda: t.orders.inner_join(t.customer, {"o_custkey": "c_custkey"}, relationship="one-to-one")), kinds=_refused(lambda: t.nation.inner_join(t.region, {"n_name": "r_regionkey"})), twice=_refused(lambda: t.nation.inner_join(t.region, join_by("n_regionkey == r_regionkey", "n_regionkey == r_name"))), unknown=_refused(lambda: t.nation.inner_join(t.region, "nope")), one=_refused(lambda: t.orders.inner_join(t.customer, {"o_custkey": "c_custkey"}, relationship="many-to-one"))), "SELECT unnest(['many', 'kinds', 'twice', 'unknown', 'one']) AS name, unnest(['ValueError', 'TypeError', 'ValueError', 'KeyError', 'None']) AS answer"),
        # more of groups
        ("group_counts", lambda t: t.answers(n=t.part.group_by("p_brand").n_groups(), vars=",".join(t.part.group_by("p_brand", "p_type").group_vars()), drop=t.part.group_by("p_brand", _drop=False).group_by_drop_default(), sizes=sum(t.nation.group_by("n_regionkey").group_size()), rows=len(t.nation.group_by("n_regionkey").group_rows())), "SELECT unnest(['n', 'vars', 'drop', 'sizes', 'rows']) AS name, unnest([(SELECT count(DISTINCT p_brand)::VARCHAR FROM part), 'p_brand,p_type', 'False', (SELECT count(*)::VARCHAR FROM nation), (SELECT count(DISTINCT n_regionkey)::VARCHAR FROM nation)]) AS answer"),
        ("group_trim", lambda t: _leveled(t).group_by("event_type", _drop=False).group_trim().count("event_type", _drop=False), "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1"),
        ("count_empty_levels_nested", lambda t: _leveled(t).mutate(part=f.if_else(col("event_id") % 2 == 0, "even", "odd")).factor("part", ["even", "none", "odd"]).count("event_type", "part", _drop=False), "SELECT l.event_type, p.part, count(e.event_id) AS n FROM (SELECT unnest(['click', 'error', 'none', 'view']) AS event_type) l CROSS JOIN (SELECT unnest(['even', 'none', 'odd']) AS part) p LEFT JOIN (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS part FROM events) e ON l.event_type = e.event_type AND p.part = e.part GROUP BY ALL"),
        ("group_split", lambda t: (lambda parts: parts[0].bind_rows(*parts[1:], _id="part"))(t.nation.group_split("n_regionkey")), "SELECT CAST(n_regionkey + 1 AS VARCHAR) AS part, n_nationkey, n_name, n_regionkey FROM nation"),
        ("group_map", lambda t: from_rows(t.spark, t.nation.group_by("n_regionkey").group_map(lambda part, key: (key[0], part.df.count())), "n_regionkey long, n long"), "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1"),
        ("group_walk", lambda t: (lambda seen: t.region.group_by("r_name").group_walk(lambda part, key: seen.append(key[0])).ungroup().mutate(seen=len(seen)))([]), "SELECT *, 5 AS seen FROM region"),
        ("do", lambda t: t.part.group_by("p_type").do(lambda d, key: d.head(1)[["p_size"]].assign(p_size=len(d)), "p_size long").ungroup(), "SELECT p_type, count(*) AS p_size FROM part GROUP BY 1"),
        ("cur_group", lambda t: t.nation.group_by("n_regionkey").mutate(key=f.fn("to_json", f.cur_group()), row=f.cur_group_rows()).ungroup().select("n_name", "key", "row"), "SELECT n_name, '{\"n_regionkey\":' || n_regionkey || '}' AS key, row_number() OVER (ORDER BY n_nationkey) AS row FROM nation"),
        ("rowwise_summarise", lambda t: t.part.rowwise("p_partkey").summarise(m=f.mean(f.row_means("p_size", "p_retailprice")), s=f.sum("p_size")).ungroup().mutate(m=rounded("m", 4)), "SELECT p_partkey, round((p_size + p_retailprice) / 2.0, 4) AS m, p_size AS s FROM part"),
        ("set_grouped", lambda t: t.nation.group_by("n_regionkey").union(t.nation.filter(col("n_nationkey") > 3)).summarise(n=f.n()), "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1"),
        # more of aggregates and windows
        ("reframe_unique", lambda t: events(t).reframe(kind=f.unique("event_type"), _by="user_id"), "SELECT DISTINCT user_id, event_type AS kind FROM events"),
        ("reframe_range", lambda t: t.part.reframe(ends=f.range("p_size"), _by="p_brand"), "SELECT p_brand, min(p_size) AS ends FROM part GROUP BY 1 UNION ALL SELECT p_brand, max(p_size) FROM part GROUP BY 1"),
        ("ranks_of_several_keys", lambda t: t.part.group_by("p_brand").mutate(a=f.min_rank("p_size", desc("p_retailprice")), b=f.row_number("p_type", "p_partkey")).ungroup().select("p_partkey", "a", "b"), "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_partkey) AS b FROM part"),
        ("cumprod", lambda t: t.supplier.arrange("s_suppkey").group_by("s_nationkey").mutate(p=rounded(f.cumprod(col("s_acctbal") / 10000 + 1), 6)).ungroup().select("s_suppkey", "p"), "SELECT s_suppkey, round(product(s_acctbal / 10000 + 1) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 6) AS p FROM supplier"),
        ("order_by", lambda t: t.events.group_by("user_id").mutate(s=f.order_by(desc("event_id"), f.cumsum("event_id")), b=f.order_by("event_id", f.lag("event_id"))).ungroup().select("event_id", "s", "b"), "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS BIGINT) AS s, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events"),
        ("ends_after_descending", lambda t: t.orders.arrange("o_orderpriority", desc("o_orderstatus"), desc("o_orderdate"), "o_orderkey").group_by("o_custkey").summarise(a=f.first("o_orderkey"), b=f.last("o_orderkey")), "SELECT o_custkey, arg_min(o_orderkey, r) AS a, arg_max(o_orderkey, r) AS b FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus DESC, o_orderdate DESC, o_orderkey) AS r FROM orders) GROUP BY 1"),
        ("top_frac", lambda t: t.customer.group_by("c_mktsegment").top_frac(0.1, "c_acctbal").ungroup().select("c_custkey"), "SELECT c_custkey FROM customer QUALIFY rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) <= floor(0.1 * count(*) OVER (PARTITION BY c_mktsegment))"),
        # more of sets and functions
        ("set_tests", lambda t: t.answers(same=t.nation.setequal(t.nation.bind_rows(t.nation)), often=t.nation.all_equal(t.nation.bind_rows(t.nation)), order=t.nation.all_equal(t.nation.arrange(desc("n_name"))), other=_refused(lambda: t.nation.union(t.region)), kinds=_refused(lambda: t.region.select(k="r_name").union(t.region.select(k="r_regionkey")))), "SELECT unnest(['same', 'often', 'order', 'other', 'kinds']) AS name, unnest(['True', 'False', 'True', 'ValueError', 'TypeError']) AS answer"),
        ("mathematics", lambda t: t.part.transmute(p_partkey=col("p_partkey"), s=rounded(f.sqrt("p_size"), 6), n=rounded(f.log("p_size"), 6), a=f.abs(col("p_size") - 25), w=f.floor("p_retailprice")), "SELECT p_partkey, round(sqrt(p_size), 6) AS s, round(ln(p_size), 6) AS n, abs(p_size - 25) AS a, CAST(floor(p_retailprice) AS BIGINT) AS w FROM part"),
        ("as_date", lambda t: t.orders.transmute(o_orderkey=col("o_orderkey"), d=f.as_date("o_orderdate")), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders"),
        ("row_means", lambda t: t.part.transmute(p_partkey=col("p_partkey"), m=f.row_means("p_size", "p_partkey"), s=f.row_sums("p_size", f.na_if("p_size", 1), na_rm=True)), "SELECT p_partkey, (p_size + p_partkey) / 2.0 AS m, p_size + coalesce(nullif(p_size, 1), 0) AS s FROM part"),
        ("recode_factor", lambda t: t.events.recode_factor("event_type", {"view": "seen", "click": "used"}, default="other").count("event_type", _drop=False), "SELECT CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'used' ELSE 'other' END AS event_type, count(*) AS n FROM events GROUP BY 1"),
        # the other scoped forms
        ("mutate_all", lambda t: t.nation.select("n_nationkey", "n_regionkey").mutate_all(lambda v: v + 1), "SELECT n_nationkey + 1 AS n_nationkey, n_regionkey + 1 AS n_regionkey FROM nation"),
        ("mutate_at", lambda t: t.nation.mutate_at(vars_("n_regionkey"), {"twice": lambda v: v * 2}), "SELECT *, n_regionkey * 2 AS twice FROM nation"),
        ("transmute_all", lambda t: t.nation.select("n_nationkey", "n_regionkey").transmute_all(lambda v: -v), "SELECT -n_nationkey AS n_nationkey, -n_regionkey AS n_regionkey FROM nation"),
        ("transmute_if", lambda t: t.nation.transmute_if(is_numeric, lambda v: v * 10), "SELECT n_nationkey * 10 AS n_nationkey, n_regionkey * 10 AS n_regionkey FROM nation"),
        ("transmute_at", lambda t: t.nation.transmute_at(["n_nationkey"], lambda v: v + 100), "SELECT n_nationkey + 100 AS n_nationkey FROM nation"),
        ("summarise_all", lambda t: t.part.select("p_brand", "p_size", "p_retailprice").group_by("p_brand").summarise_all(f.max), "SELECT p_brand, max(p_size) AS p_size, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1"),
        ("summarise_if", lambda t: t.part.group_by("p_brand").summarise_if(is_character, f.n_distinct), "SELECT p_brand, count(DISTINCT p_name) AS p_name, count(DISTINCT p_type) AS p_type FROM part GROUP BY 1"),
        ("filter_if", lambda t: t.nation.filter_if(is_numeric, any_vars(lambda v: v == 3)), "SELECT * FROM nation WHERE n_nationkey = 3 OR n_regionkey = 3"),
        ("arrange_if", lambda t: t.region.arrange_if(is_character, desc).mutate(place=f.row_number()), "SELECT *, row_number() OVER (ORDER BY r_name DESC) AS place FROM region"),
        ("arrange_at", lambda t: t.nation.arrange_at(["n_regionkey", "n_nationkey"]).mutate(place=f.row_number()), "SELECT *, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS place FROM nation"),
        ("distinct_all", lambda t: t.part.select("p_brand", "p_type").distinct_all(), "SELECT DISTINCT p_brand, p_type FROM part"),
        ("distinct_if", lambda t: t.nation.select("n_name", "n_regionkey").distinct_if(is_numeric), "SELECT DISTINCT n_regionkey FROM nation"),
        ("group_by_all", lambda t: t.part.select("p_brand", "p_type").group_by_all().tally(), "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL"),
        ("group_by_if", lambda t: t.part.select("p_brand", "p_size").group_by_if(is_character).tally(), "SELECT p_brand, count(*) AS n FROM part GROUP BY 1"),
        ("select_all", lambda t: t.region.select_all(str.upper), "SELECT r_regionkey AS R_REGIONKEY, r_name AS R_NAME FROM region"),
        ("select_at", lambda t: t.nation.select_at(["n_name"], lambda n: n[2:]), "SELECT n_name AS name FROM nation"),
        ("rename_all", lambda t: t.region.rename_all(lambda n: n[2:]), "SELECT r_regionkey AS regionkey, r_name AS name FROM region"),
        ("rename_if", lambda t: t.nation.rename_if(is_numeric, str.upper), "SELECT n_nationkey AS N_NATIONKEY, n_name, n_regionkey AS N_REGIONKEY FROM nation"),
        ("rename_at", lambda t: t.nation.rename_at(["n_name"], str.title), "SELECT n_nationkey, n_name AS N_Name, n_regionkey FROM nation"),
    ):
        query(name, text)(function)


def _drawn(table: Frame, sample: Frame, key: str, *by: str) -> Frame:
    """How many rows a sample has, and how many different ones of them the table has."""
    counts = sample.summarise(n=f.n(), _by=list(by)) if by else sample.summarise(n=f.n())
    known = sample.distinct(key, *by).semi_join(table, [key, *by])
    if not by:
        return counts.bind_cols(known.summarise(known=f.n()))
    return counts.left_join(known.summarise(known=f.n(), _by=list(by)), list(by))


def _refused(attempt: Callable[[], Any]) -> str:
    """The kind of error that something raises."""
    try:
        attempt()
    except (ValueError, TypeError, KeyError) as e:
        return type(e).__name__
    return "None"


def desc_value() -> Expr:
    return -col("value")


def _purchases(t: Tables) -> Frame:
    return t.events.filter(col("event_type") == "purchase").select("event_id", "user_id", "ts")


def _views(t: Tables) -> Frame:
    return t.events.filter(col("event_type") == "view").select("user_id", view_id="event_id", seen="ts")


def _sessions(t: Tables) -> Frame:
    return t.events.mutate(session=col("event_id") // 500).summarise(first=f.min("event_id"), last=f.max("event_id"), _by=["user_id", "session"])


def _changes(t: Tables) -> Frame:
    keys = t.nation.filter(col("n_nationkey").isin(1, 24)).mutate(n_nationkey=f.case_when((col("n_nationkey") == 24, 30), default=col("n_nationkey")))
    return keys.mutate(n_name="NEW", n_regionkey=0)


def _leveled(t: Tables) -> Frame:
    return t.events.filter(col("event_type").isin("click", "error", "view")).factor("event_type", ["click", "error", "none", "view"])


_all()
