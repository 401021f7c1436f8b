"""Vectorised conditionals, recoding and missing values, with strict types."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expr import Expr, as_expr, named

__all__ = ["if_else", "case_when", "replace_when", "recode_values", "replace_values", "case_match", "recode", "coalesce", "na_if", "between", "near", "when_any", "when_all", "xor"]


def common_type(context, columns: Iterable[Column]) -> T.DataType | None:
    """The type that all columns share; numbers widen, anything else must agree."""
    kinds = [k for k in map(context.type_of, columns) if not isinstance(k, T.NullType)]
    if not kinds:
        return None
    if len(set(kinds)) == 1:
        return kinds[0]
    if all(isinstance(k, T.NumericType) for k in kinds):
        for wide in (T.DoubleType(), T.FloatType()):
            if wide in kinds:
                return T.DoubleType()
        decimals = [k for k in kinds if isinstance(k, T.DecimalType)]
        if decimals:
            scale = max(k.scale for k in decimals)
            return T.DecimalType(38, scale)
        return T.LongType() if T.LongType() in kinds else T.IntegerType()
    if all(isinstance(k, (T.DateType, T.TimestampType)) for k in kinds):
        return T.TimestampType()
    raise TypeError("values of different types: " + ", ".join(sorted({k.simpleString() for k in kinds})))


def _same_type(context, columns: list[Column]) -> list[Column]:
    kind = common_type(context, columns)
    return [c.cast(kind) for c in columns] if kind is not None else columns


def if_else(condition: Any, true: Any, false: Any, missing: Any = None) -> Expr:
    """true or false by the condition, `missing` where that is missing."""

    def build(c, test: Column, *values: Column) -> Column:
        t, f, m = _same_type(c, list(values))
        return F.when(test.isNull(), m).when(test, t).otherwise(f)

    return Expr("if_else", (condition, true, false, missing), build)


def _cases(label: str, conditions: list[Expr], values: list[Expr], default: Any, unmatched: str, x: Expr | None = None) -> Expr:
    """The value of the first true condition; x fixes the type and is what else there is."""
    if unmatched not in ("default", "error"):
        raise ValueError('unmatched is "default" or "error"')
    k = len(conditions)

    def build(c, *columns: Column) -> Column:
        tests, found, rest = columns[:k], list(columns[k : 2 * k]), columns[-1]
        if x is not None:
            kind = c.type_of(rest)
            common_type(c, [*found, rest])
            found = [f.cast(kind) for f in found]
        else:
            *found, rest = _same_type(c, [*found, rest])
        if unmatched == "error":
            rest = F.raise_error(F.lit(f"{label}(): a row matches no case"))
        if not tests:
            return rest
        return reduce(lambda w, p: w.when(*p), list(zip(tests, found))[1:], F.when(tests[0], found[0])).otherwise(rest)

    return Expr(label, [*conditions, *values, x if x is not None else as_expr(default)], build)


def case_when(*cases: tuple[Any, Any], default: Any = None, unmatched: str = "default") -> Expr:
    """The value of the first case whose condition is true; missing conditions do not match."""
    return _cases("case_when", [as_expr(c) for c, _ in cases], [as_expr(v) for _, v in cases], default, unmatched)


def replace_when(x: Any, *cases: tuple[Any, Any]) -> Expr:
    """x with the value of the first case whose condition is true; x keeps its type."""
    return _cases("replace_when", [as_expr(c) for c, _ in cases], [as_expr(v) for _, v in cases], None, "default", named(x))


def _matches(x: Expr, old: Any) -> Expr:
    """Whether x is one of some values, a missing one included."""
    given = list(old) if isinstance(old, (list, tuple, set)) else [old]
    tests = [Expr("is", (x, v), lambda c, a, b: a.eqNullSafe(b)) for v in given]
    return reduce(or_, tests) if tests else as_expr(False)


def _pairs(cases: tuple, from_: Any, to: Any) -> list[tuple[Any, Any]]:
    if from_ is not None or to is not None:
        if cases:
            raise ValueError("give cases or from_ and to, not both")
        if from_ is None or to is None:
            raise ValueError("from_ and to go together")
        new = list(to) if isinstance(to, (list, tuple)) else [to] * len(from_)
        if len(new) != len(from_):
            raise ValueError("from_ and to have one length")
        return list(zip(from_, new))
    if not cases:
        raise ValueError("there are no cases")
    return list(cases)


def recode_values(x: Any, *cases: tuple[Any, Any], from_: Any = None, to: Any = None, default: Any = None, unmatched: str = "default") -> Expr:
    """New values for old ones, from cases (old or a list of old, new) or two lists."""
    x, pairs = named(x), _pairs(cases, from_, to)
    return _cases("recode_values", [_matches(x, old) for old, _ in pairs], [as_expr(v) for _, v in pairs], default, unmatched)


def replace_values(x: Any, *cases: tuple[Any, Any], from_: Any = None, to: Any = None) -> Expr:
    """As recode_values(), other values staying as they are."""
    x, pairs = named(x), _pairs(cases, from_, to)
    return _cases("replace_values", [_matches(x, old) for old, _ in pairs], [as_expr(v) for _, v in pairs], None, "default", x)


def case_match(x: Any, *cases: tuple[Any, Any], default: Any = None) -> Expr:
    """An older name of recode_values()."""
    return recode_values(x, *cases, default=default)


def recode(x: Any, mapping: dict, default: Any = None, missing: Any = None) -> Expr:
    """New values by a mapping; others stay if `default` is not given, missing ones become `missing`."""
    x = named(x)
    pairs = list(mapping.items())
    tests, values = [_matches(x, old) for old, _ in pairs], [as_expr(v) for _, v in pairs]
    if missing is not None:
        tests, values = [x.is_na(), *tests], [as_expr(missing), *values]
    if default is None:
        return _cases("recode", tests, values, None, "default", x)
    filled = if_else(x.is_na(), None, default)
    return _cases("recode", tests, values, filled, "default")


def coalesce(*xs: Any) -> Expr:
    """The first value that is neither null nor NaN; Python's None is left out."""
    given = [named(x) for x in xs if x is not None]
    if not given:
        raise ValueError("coalesce() takes at least one value")

    def build(c, *columns: Column) -> Column:
        columns = _same_type(c, list(columns))
        return F.coalesce(*(c.without_nan(v) for v in columns[:-1]), columns[-1])

    return Expr("coalesce", given, build)


def na_if(x: Any, y: Any) -> Expr:
    """x, missing where it equals y."""

    def build(c, a: Column, b: Column) -> Column:
        common_type(c, [a, b])
        return F.when(a.eqNullSafe(b.cast(c.type_of(a))), None).otherwise(a)

    return Expr("na_if", (named(x), y), build)


def between(x: Any, left: Any, right: Any) -> Expr:
    """left <= x <= right, in a common type."""

    def build(c, *columns: Column) -> Column:
        v, low, high = _same_type(c, list(columns))
        return (v >= low) & (v <= high)

    return Expr("between", (named(x), left, right), build)


def near(x: Any, y: Any, tolerance: float = 2.0**-26) -> Expr:
    """Whether two numbers differ by less than a tolerance."""
    return Expr("near", (named(x), named(y)), lambda c, a, b: F.abs(a - b) < tolerance)


def _combined(label: str, conditions: tuple[Any, ...], na_rm: bool, join, identity: bool) -> Expr:
    def build(c, *columns: Column) -> Column:
        columns = [F.coalesce(v, F.lit(identity)) if na_rm else v for v in columns]
        return reduce(join, columns, F.lit(identity))

    return Expr(label, [named(x) for x in conditions], build)


def when_any(*conditions: Any, na_rm: bool = False) -> Expr:
    """Row by row, whether one condition is true, in three-valued logic."""
    return _combined("when_any", conditions, na_rm, or_, False)


def when_all(*conditions: Any, na_rm: bool = False) -> Expr:
    """Row by row, whether all conditions are true, in three-valued logic."""
    return _combined("when_all", conditions, na_rm, and_, True)


def xor(x: Any, y: Any) -> Expr:
    return named(x) ^ named(y)
