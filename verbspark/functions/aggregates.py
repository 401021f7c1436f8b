"""Aggregates; a missing value makes the result missing unless na_rm is set."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import AGG, Expr, as_expr, named
from .windows import dense_rank, row_number

__all__ = ["n", "sum", "mean", "median", "sd", "var", "min", "max", "any", "all", "prod", "quantile", "iqr", "mad", "n_distinct", "first", "last", "nth", "approx_n_distinct", "pandas_agg", "values", "which", "unique", "range"]


def _guarded(label: str, x: Any, na_rm: bool, function: Callable[[Column], Column], empty: Any = None, scalar: Callable[..., Column] | None = None) -> Expr:
    """function over the values; null if one is missing and na_rm is not set; `empty` where there are none."""

    def build(c, v: Column) -> Column:
        value = c.over(function(v))
        if empty is not None:
            value = F.coalesce(value, F.lit(empty))
        return value if na_rm else F.when(c.over(F.count(v)) == c.over(F.count(F.lit(1))), value)

    return Expr(label, (named(x),), build, AGG, scalar or (lambda c, v: F.coalesce(v, F.lit(empty)) if na_rm and empty is not None else v))


def n() -> Expr:
    """The number of rows of the group."""
    return Expr("n", (), lambda c: c.over(F.count(F.lit(1))), AGG, lambda c: F.lit(1).cast("long"))


def sum(x: Any, na_rm: bool = False) -> Expr:  # noqa: A001
    """The sum; 0 without values."""

    def build(c, v: Column) -> Column:
        value = F.coalesce(c.over(F.sum(v)), F.lit(0))
        return value if na_rm else F.when(c.over(F.count(v)) == c.over(F.count(F.lit(1))), value)

    return Expr("sum", (named(x),), build, AGG, lambda c, v: F.coalesce(v, F.lit(0)) if na_rm else v)


def mean(x: Any, na_rm: bool = False) -> Expr:
    return _guarded("mean", x, na_rm, F.avg, scalar=lambda c, v: v.cast("double"))


def median(x: Any, na_rm: bool = False) -> Expr:
    return _guarded("median", x, na_rm, F.median, scalar=lambda c, v: v.cast("double"))


def sd(x: Any, na_rm: bool = False) -> Expr:
    return _guarded("sd", x, na_rm, F.stddev_samp, scalar=lambda c, v: F.lit(None).cast("double"))


def var(x: Any, na_rm: bool = False) -> Expr:
    return _guarded("var", x, na_rm, F.var_samp, scalar=lambda c, v: F.lit(None).cast("double"))


def min(x: Any, na_rm: bool = False) -> Expr:  # noqa: A001
    return _guarded("min", x, na_rm, F.min)


def max(x: Any, na_rm: bool = False) -> Expr:  # noqa: A001
    return _guarded("max", x, na_rm, F.max)


def range(x: Any, na_rm: bool = False) -> Expr:  # noqa: A001
    """The smallest and the largest value, as an array for reframe()."""
    return Expr("range", (min(x, na_rm), max(x, na_rm)), lambda c, low, high: F.array(low, high))


def prod(x: Any, na_rm: bool = False) -> Expr:
    return _guarded("prod", x, na_rm, F.product, empty=1.0)


def any(x: Any, na_rm: bool = False) -> Expr:  # noqa: A001
    """Whether one value is true; missing if none is and one is missing."""

    def build(c, v: Column) -> Column:
        true = F.coalesce(c.over(F.bool_or(v)), F.lit(False))
        return true if na_rm else F.when(true, True).when(c.over(F.count(v)) == c.over(F.count(F.lit(1))), False)

    return Expr("any", (named(x),), build, AGG, lambda c, v: v)


def all(x: Any, na_rm: bool = False) -> Expr:  # noqa: A001
    """Whether no value is false; missing if none is and one is missing."""

    def build(c, v: Column) -> Column:
        true = F.coalesce(c.over(F.bool_and(v)), F.lit(True))
        return true if na_rm else F.when(~true, False).when(c.over(F.count(v)) == c.over(F.count(F.lit(1))), True)

    return Expr("all", (named(x),), build, AGG, lambda c, v: v)


def quantile(x: Any, probability: float, na_rm: bool = False) -> Expr:
    """The quantile by linear interpolation."""
    return _guarded("quantile", x, na_rm, lambda v: F.percentile(v, F.lit(probability)), scalar=lambda c, v: v.cast("double"))


def iqr(x: Any, na_rm: bool = False) -> Expr:
    return quantile(x, 0.75, na_rm) - quantile(x, 0.25, na_rm)


def mad(x: Any, na_rm: bool = False) -> Expr:
    """The median absolute deviation, scaled to a normal distribution's deviation."""
    away = Expr("abs", (named(x) - median(x, na_rm),), lambda c, v: F.abs(v))
    return median(away, na_rm) * 1.4826


def n_distinct(*xs: Any, na_rm: bool = False) -> Expr:
    """The number of different combinations; with na_rm those without a missing value."""
    children = [named(x) for x in xs]

    def build(c, *v: Column) -> Column:
        return F.count_distinct(*v) if na_rm else F.count_distinct(F.struct(*(x.alias(f"x{i}") for i, x in enumerate(v))))

    def widest(c, rank: Column) -> Column:
        return F.coalesce(c.over(F.max(rank)), F.lit(0)).cast("long")

    in_window = Expr("n_distinct", (dense_rank(*children, keep_missing=not na_rm),), widest, AGG)
    return Expr("n_distinct", children, build, AGG, lambda c, *v: F.lit(1).cast("long"), in_window)


def approx_n_distinct(x: Any, error: float = 0.05) -> Expr:
    """About how many different values there are, missing ones not counted; a sketch of fixed size."""
    return Expr("approx_n_distinct", (named(x),), lambda c, v: c.over(F.approx_count_distinct(v, error)), AGG, lambda c, v: v.isNotNull().cast("long"))


def _end(label: str, function: Callable, x: Any, order_by: Any, default: Any, na_rm: bool) -> Expr:
    children = [named(x), *([named(order_by)] if order_by is not None else []), *([as_expr(default)] if default is not None else [])]

    def build(c, v: Column, *more: Column) -> Column:
        place = c.position()
        if order_by is not None:
            missing = more[0].isNull() if label == "first" else more[0].isNotNull()
            place = F.struct(missing.alias("m"), more[0].alias("o"), place.alias("p"))
        wanted = F.when(~c.missing(v), place) if na_rm else place
        value = c.over(function(v, wanted))
        if default is not None:
            value = F.when(c.over(F.count(wanted)) > 0, value).otherwise(c.over(F.first(more[-1])).cast(c.type_of(v)))
        return value

    out = Expr(label, children, build, AGG, lambda c, v, *more: v)
    out.reordered = lambda by: _end(label, function, x, by, default, na_rm)
    return out


def first(x: Any, order_by: Any = None, default: Any = None, na_rm: bool = False) -> Expr:
    """The first value in row order or by order_by; `default` if there is none."""
    return _end("first", F.min_by, x, order_by, default, na_rm)


def last(x: Any, order_by: Any = None, default: Any = None, na_rm: bool = False) -> Expr:
    return _end("last", F.max_by, x, order_by, default, na_rm)


def nth(x: Any, place: int, order_by: Any = None, default: Any = None, na_rm: bool = False) -> Expr:
    """The value at a place, from 1; negative places count from the end."""
    if place == 0:
        return as_expr(default)
    value = named(x)
    where = ~value.is_na() if na_rm else None
    number = row_number(*([order_by] if order_by is not None else []), where=where)
    size = Expr("size", (where if where is not None else as_expr(True),), lambda c, w: c.over(F.count(F.when(w, 1))), AGG)

    def build(c, v: Column, rank: Column, total: Column, *more: Column) -> Column:
        at = rank == (total + place + 1 if place < 0 else F.lit(place))
        found = c.over(F.max_by(v, F.when(at, 1)))
        if not more:
            return found
        return F.when(c.over(F.count(F.when(at, 1))) > 0, found).otherwise(c.over(F.first(more[0])).cast(c.type_of(v)))

    children = [value, number, size, *([as_expr(default)] if default is not None else [])]
    return Expr("nth", children, build, AGG, lambda c, v, *more: v)


def pandas_agg(function: Callable, kind: str, *xs: Any) -> Expr:
    """Any function of pandas Series to one value; Spark allows no other kind of aggregate beside it."""
    udf = F.pandas_udf(function, kind, F.PandasUDFType.GROUPED_AGG)
    out = Expr(getattr(function, "__name__", "pandas_agg"), [named(x) for x in xs], lambda c, *v: c.over(udf(*v)), AGG)
    out.alone = True
    return out


def _gathered(label: str, x: Any, finish: Callable[[Column], Column], where: Expr | None = None) -> Expr:
    """Values of a group in row order as an array; a group must fit a task."""
    children = [named(x), *([where] if where is not None else [])]

    def build(c, v: Column, *more: Column) -> Column:
        item = F.struct(c.position().alias("place"), v.alias("value"))
        if more:
            item = F.when(more[0], item)
        ordered = F.array_sort(c.over(F.collect_list(item)))
        return finish(F.transform(ordered, lambda s: s["value"]))

    return Expr(label, children, build, AGG, lambda c, v, *more: F.array(v))


def values(x: Any, where: Expr | None = None) -> Expr:
    """All values, or those where a condition is true, as an array for reframe()."""
    return _gathered("values", x, lambda a: a, where)


def which(condition: Any) -> Expr:
    """The places in the group where a condition is true, as an array for reframe()."""
    return _gathered("which", row_number(), lambda a: a, as_expr(condition))


def unique(x: Any) -> Expr:
    """The different values in the order of their first rows, as an array for reframe()."""
    return _gathered("unique", x, F.array_distinct)
