"""Functions of a row's place among its group: ranks, offsets, running values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.expr import WIN, Desc, Expr, as_expr, named, quoted

__all__ = [
    "row_number", "min_rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "cumsum", "cummin", "cummax", "cumprod", "cummean", "cumall", "cumany",
    "consecutive_id", "with_order", "order_by", "cur_group_id", "cur_group", "cur_group_rows",
]


def _ranked(label: str, xs: tuple[Any, ...], rank: Callable[..., Column], ties: bool, where: Expr | None = None, keep_missing: bool = False) -> Expr:
    """A rank over the rows whose keys are complete; null for the others."""
    keys = [x if isinstance(x, Desc) else named(x) for x in xs]
    down = [isinstance(k, Desc) for k in keys]
    children = [*keys, *([where] if where is not None else [])]

    def build(c, *v: Column) -> Column:
        values, out = v[: len(keys)], []
        if keys and not keep_missing:
            out = [c.missing(x) for x in values]
        if where is not None:
            out.append(~F.coalesce(v[-1], F.lit(False)))
        left_out = reduce(or_, out) if out else None
        by = [F.desc_nulls_last(x) if d else F.asc_nulls_last(x) for x, d in zip(values, down)]
        spec = c.window(by, [left_out] if out else None, ties)
        value = rank(spec)
        return F.when(~left_out, value) if out else value

    return Expr(label, children, build, WIN, lambda c, *v: F.lit(1))


def row_number(*xs: Any, where: Expr | None = None) -> Expr:
    """The place in the group, by the keys and then in row order."""
    return _ranked("row_number", xs, lambda spec: F.row_number().over(spec), False, where)


def min_rank(*xs: Any) -> Expr:
    """Ranks with gaps, equal keys sharing the smallest."""
    return _ranked("min_rank", xs, lambda spec: F.rank().over(spec), True)


def dense_rank(*xs: Any, keep_missing: bool = False) -> Expr:
    """Ranks without gaps; missing keys have none unless kept as values."""
    return _ranked("dense_rank", xs, lambda spec: F.dense_rank().over(spec), True, None, keep_missing)


def percent_rank(*xs: Any) -> Expr:
    """(rank - 1) / (complete values - 1); NaN for a single value."""

    def rank(spec) -> Column:
        others = F.count(F.lit(1)).over(spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - 1
        below = (F.rank().over(spec) - 1).cast("double")
        return F.when(others == 0, float("nan")).otherwise(below / F.when(others != 0, others))

    return _ranked("percent_rank", xs, rank, True)


def cume_dist(*xs: Any) -> Expr:
    """The share of complete values up to this one."""
    return _ranked("cume_dist", xs, lambda spec: F.cume_dist().over(spec), True)


def ntile(buckets: int, *xs: Any) -> Expr:
    """Buckets of nearly equal size, larger ones first."""
    if not isinstance(buckets, int) or buckets < 1:
        raise ValueError("the number of buckets is a positive whole number")
    return _ranked("ntile", xs, lambda spec: F.ntile(buckets).over(spec), False)


def _sorted(order_by: Any) -> tuple[list[Expr], bool]:
    if order_by is None:
        return [], False
    return [named(order_by) if not isinstance(order_by, Desc) else order_by], isinstance(order_by, Desc)


def _by(columns: tuple[Column, ...], down: bool) -> list[Column]:
    return [F.desc_nulls_last(x) if down else F.asc_nulls_last(x) for x in columns]


def _shifted(label: str, function: Callable, x: Any, places: int, default: Any, order_by: Any) -> Expr:
    if not isinstance(places, int) or places < 0:
        raise ValueError("the number of places is a whole number from 0")
    order, down = _sorted(order_by)
    fill = [as_expr(default)] if default is not None else []

    def build(c, v: Column, *more: Column) -> Column:
        spec = c.window(_by(more[: len(order)], down))
        value = function(v, places).over(spec)
        if not fill:
            return value
        inside = function(F.lit(True), places).over(spec)
        return F.when(inside, value).otherwise(more[-1].cast(c.type_of(v)))

    out = Expr(label, [named(x), *order, *fill], build, WIN)
    out.reordered = lambda by: _shifted(label, function, x, places, default, by)
    return out


def lag(x: Any, places: int = 1, default: Any = None, order_by: Any = None) -> Expr:
    """The value some rows before."""
    return _shifted("lag", F.lag, x, places, default, order_by)


def lead(x: Any, places: int = 1, default: Any = None, order_by: Any = None) -> Expr:
    """The value some rows after."""
    return _shifted("lead", F.lead, x, places, default, order_by)


def _running(label: str, x: Any, order_by: Any, value: Callable[..., Column]) -> Expr:
    """value(v, over, all_known) on the rows so far."""
    order, down = _sorted(order_by)

    def build(c, v: Column, *more: Column) -> Column:
        spec = c.window(_by(more, down)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = lambda a: a.over(spec)
        return value(v, over, over(F.count(v)) == over(F.count(F.lit(1))))

    out = Expr(label, [named(x), *order], build, WIN, lambda c, v, *more: v)
    out.reordered = lambda by: _running(label, x, by, value)
    return out


def cumsum(x: Any, order_by: Any = None) -> Expr:
    return _running("cumsum", x, order_by, lambda v, over, known: F.when(known, over(F.sum(v))))


def cummin(x: Any, order_by: Any = None) -> Expr:
    return _running("cummin", x, order_by, lambda v, over, known: F.when(known, over(F.min(v))))


def cummax(x: Any, order_by: Any = None) -> Expr:
    return _running("cummax", x, order_by, lambda v, over, known: F.when(known, over(F.max(v))))


def cumprod(x: Any, order_by: Any = None) -> Expr:
    return _running("cumprod", x, order_by, lambda v, over, known: F.when(known, over(F.product(v))))


def cummean(x: Any, order_by: Any = None) -> Expr:
    return _running("cummean", x, order_by, lambda v, over, known: F.when(known, over(F.avg(v))))


def cumall(x: Any, order_by: Any = None) -> Expr:
    """Whether all values so far are true, in three-valued logic."""
    return _running("cumall", x, order_by, lambda v, over, known: F.when(~over(F.bool_and(v)), False).when(known, True))


def cumany(x: Any, order_by: Any = None) -> Expr:
    """Whether one value so far is true, in three-valued logic."""
    return _running("cumany", x, order_by, lambda v, over, known: F.when(over(F.bool_or(v)), True).when(known, False))


def consecutive_id(*xs: Any, order_by: Any = None) -> Expr:
    """Numbers the runs of equal values; missing values are equal to each other."""
    order, down = _sorted(order_by)

    def changed(c, *v: Column) -> Column:
        values, more = v[: len(xs)], v[len(xs) :]
        row = F.struct(*(x.alias(f"x{i}") for i, x in enumerate(values)))
        before = F.lag(row).over(c.window(_by(more, down)))
        return F.when(before.isNotNull() & row.eqNullSafe(before), 0).otherwise(1)

    flag = Expr("changed", [*(named(x) for x in xs), *order], changed, WIN)
    out = _running("consecutive_id", flag, order_by, lambda v, over, known: over(F.sum(v)))
    out.reordered = lambda by: consecutive_id(*xs, order_by=by)
    return out


def with_order(order_by: Any, function: Callable[..., Expr], x: Any, **more: Any) -> Expr:
    """A window function in another order, its results at the rows' own places."""
    return function(x, order_by=order_by, **more)


def order_by(key: Any, call: Expr) -> Expr:
    """The same window function over rows in the order of a key."""
    if getattr(call, "reordered", None) is None:
        raise TypeError(f"{call!r} does not depend on the order of rows")
    return call.reordered(key)


def _numbered(keys: list[Column], df):
    """Different rows of some columns with their numbers, from 1, in ascending order.

    The rows are sorted in ranges and kept; a row's number is its place in its
    range plus the sizes of the ranges before, of which there are few.
    """
    place, part, before = "__place", "__part", "__before"
    ordered = df.distinct().orderBy(*keys).withColumn(place, F.monotonically_increasing_id()).persist()
    sizes = ordered.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy().orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(part, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(before))
    joined = ordered.join(F.broadcast(sizes), F.shiftright(place, 33) == F.col(part))
    return joined.withColumn("__id", (F.col(place).bitwiseAND((1 << 33) - 1) + F.col(before) + 1).cast("int")).drop(place, part, before)


def cur_group_id() -> Expr:
    """The group's number, from 1, with groups in ascending order of their keys."""

    def build(c) -> Column:
        if not c.groups:
            return F.lit(1)

        keys = [F.asc_nulls_last(quoted(g)) for g in c.groups]
        return c.looked_up(_numbered(keys, c.df.select(*(quoted(g) for g in c.groups))), "__id")

    return Expr("cur_group_id", (), build, WIN)


def cur_group() -> Expr:
    """The group's keys as one value."""

    return Expr("cur_group", (), lambda c: F.struct(*(quoted(g) for g in c.groups)))


def cur_group_rows() -> Expr:
    """The row's number in the whole table, from 1."""

    def build(c) -> Column:
        groups, c.groups = c.groups, []
        value = F.row_number().over(c.window())
        c.groups = groups
        return value

    return Expr("cur_group_rows", (), build, WIN)
