"""Scalar functions: Spark's own, and those whose rules for missing values or rounding differ."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import Expr, as_expr, named

__all__ = ["fn", "is_na", "is_nan", "pmin", "pmax", "round", "paste", "diff", "cut", "row_sums", "row_means", "c_array", "pandas_scalar", "sqrt", "abs", "log", "floor", "upper", "grepl", "as_date", "sql_expr", "struct_of"]


def fn(name: str, *xs: Any) -> Expr:
    """Any function of pyspark.sql.functions, by name; strings are columns."""
    function = getattr(F, name)
    return Expr(name, [named(x) for x in xs], lambda c, *v: function(*v))


def sqrt(x: Any) -> Expr:
    return fn("sqrt", x)


def abs(x: Any) -> Expr:  # noqa: A001
    return fn("abs", x)


def log(x: Any) -> Expr:
    return fn("log", x)


def floor(x: Any) -> Expr:
    return fn("floor", x)


def upper(x: Any) -> Expr:
    return fn("upper", x)


def grepl(pattern: str, x: Any) -> Expr:
    """Whether a pattern is found; false for a missing text."""
    return Expr("grepl", (named(x),), lambda c, v: F.coalesce(v.rlike(pattern), F.lit(False)))


def as_date(x: Any) -> Expr:
    return fn("to_date", x)


def sql_expr(text: str) -> Expr:
    """A Spark SQL expression."""
    return as_expr(F.expr(text))


def is_na(x: Any) -> Expr:
    """Null or NaN."""
    return named(x).is_na()


def is_nan(x: Any) -> Expr:
    return Expr("is_nan", (named(x),), lambda c, v: F.coalesce(F.isnan(v), F.lit(False)))


def _across_columns(label: str, xs: tuple[Any, ...], na_rm: bool, function: Callable[..., Column]) -> Expr:
    def build(c, *v: Column) -> Column:
        value = function(*v) if len(v) > 1 else v[0]
        return value if na_rm else F.when(reduce(and_, (x.isNotNull() for x in v)), value)

    return Expr(label, [named(x) for x in xs], build)


def pmin(*xs: Any, na_rm: bool = False) -> Expr:
    """The smallest of some columns in each row."""
    return _across_columns("pmin", xs, na_rm, F.least)


def pmax(*xs: Any, na_rm: bool = False) -> Expr:
    """The largest of some columns in each row."""
    return _across_columns("pmax", xs, na_rm, F.greatest)


def round(x: Any, digits: int = 0) -> Expr:  # noqa: A001
    """Rounds halves to even."""
    return Expr("round", (named(x),), lambda c, v: F.bround(v, digits))


def paste(*xs: Any, sep: str = " ") -> Expr:
    """Joins texts; a missing one is the text NA."""
    return Expr("paste", [named(x) for x in xs], lambda c, *v: F.concat_ws(sep, *(F.coalesce(x.cast("string"), F.lit("NA")) for x in v)))


def diff(x: Any, places: int = 1, order_by: Any = None) -> Expr:
    """The difference from the value some rows before."""
    from .windows import lag

    return named(x) - lag(x, places, order_by=order_by)


def cut(x: Any, breaks: list[float], labels: list[str] | None = None) -> Expr:
    """The interval, open below and closed above, that a value falls in."""
    names = labels or [f"({a:g},{b:g}]" for a, b in zip(breaks, breaks[1:])]

    def build(c, v: Column) -> Column:
        out = F.lit(None).cast("string")
        for low, high, name in list(zip(breaks, breaks[1:], names))[::-1]:
            out = F.when((v > low) & (v <= high), F.lit(name)).otherwise(out)
        return out

    return Expr("cut", (named(x),), build)


def row_sums(*xs: Any, na_rm: bool = False) -> Expr:
    """The sum of some columns in each row."""
    return Expr("row_sums", [named(x) for x in xs], lambda c, *v: reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0)) if na_rm else x for x in v)))


def row_means(*xs: Any, na_rm: bool = False) -> Expr:
    """The mean of some columns in each row."""

    def build(c, *v: Column) -> Column:
        total = reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0)) if na_rm else x for x in v)).cast("double")
        if not na_rm:
            return total / len(v)
        known = reduce(lambda a, b: a + b, (x.isNotNull().cast("int") for x in v))
        return F.when(known == 0, float("nan")).otherwise(total / F.when(known != 0, known))

    return Expr("row_means", [named(x) for x in xs], build)


def struct_of(parts: dict[str, Any]) -> Expr:
    """Named values of each row as one value."""
    names = list(parts)
    return Expr("struct_of", list(parts.values()), lambda c, *v: F.struct(*(x.alias(n) for n, x in zip(names, v))))


def c_array(*xs: Any) -> Expr:
    """Some columns of each row as one array."""
    return Expr("c_array", [named(x) for x in xs], lambda c, *v: F.array(*v))


def pandas_scalar(function: Callable, kind: str, *xs: Any) -> Expr:
    """Any function of pandas Series to a Series, run in Arrow batches."""
    udf = F.pandas_udf(function, kind)
    return Expr(getattr(function, "__name__", "pandas_scalar"), [named(x) for x in xs], lambda c, *v: udf(*v))
