"""Expressions over columns, kept as trees until a verb says what they mean.

The same mean(x) is an aggregate in a summary and a window in a mutation, so an
expression is not a Spark column yet.  It knows its children, its kind (per
row, aggregate or window) and how to build a column once its children are
columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW, AGG, WIN = "row", "agg", "win"


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


class Expr:
    """A node: its kind, children, and build(context, *columns)."""

    alone = False  # whether Spark allows no other kind of aggregate beside it

    def __init__(self, label: str, children: Iterable[Any] = (), build: Callable[..., Column] | None = None, kind: str = ROW, scalar: Callable[..., Column] | None = None, as_window: Expr | None = None):
        """scalar builds an aggregate of a single value; as_window replaces an aggregate that has no window form."""
        self.label, self.kind, self._build, self.scalar, self.as_window = label, kind, build, scalar, as_window
        self.children = tuple(as_expr(c) for c in children)

    def build(self, context, *columns: Column) -> Column:
        return self._build(context, *columns)

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children:
            yield from c.walk()

    def names(self) -> set[str]:
        """Columns that the expression reads."""
        return {e.name for e in self.walk() if isinstance(e, Col)}

    def with_children(self, children: Iterable[Expr]) -> Expr:
        """The same node over other children."""
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        out.children = tuple(children)
        return out

    def _op(self, label: str, other: Any, f: Callable[[Column, Column], Column]) -> Expr:
        return Expr(label, (self, other), lambda _, a, b: f(a, b))

    def _back(self, label: str, other: Any, f: Callable[[Column, Column], Column]) -> Expr:
        return Expr(label, (other, self), lambda _, a, b: f(a, b))

    def _compared(self, label: str, other: Any, f: Callable[[Column, Column], Column]) -> Expr:
        """A comparison; text and numbers are not comparable, where Spark would cast."""

        def build(context, a: Column, b: Column) -> Column:
            context.check_comparable(label, a, b)
            return f(a, b)

        return Expr(label, (self, other), build)

    def __add__(self, o): return self._op("+", o, lambda a, b: a + b)  # noqa: E704
    def __radd__(self, o): return self._back("+", o, lambda a, b: a + b)  # noqa: E704
    def __sub__(self, o): return self._op("-", o, lambda a, b: a - b)  # noqa: E704
    def __rsub__(self, o): return self._back("-", o, lambda a, b: a - b)  # noqa: E704
    def __mul__(self, o): return self._op("*", o, lambda a, b: a * b)  # noqa: E704
    def __rmul__(self, o): return self._back("*", o, lambda a, b: a * b)  # noqa: E704
    def __truediv__(self, o): return self._op("/", o, divided)  # noqa: E704
    def __rtruediv__(self, o): return self._back("/", o, divided)  # noqa: E704
    def __floordiv__(self, o): return self._op("//", o, lambda a, b: F.floor(divided(a, b)))  # noqa: E704
    def __mod__(self, o): return self._op("%", o, lambda a, b: a - b * F.floor(divided(a, b)))  # noqa: E704
    def __pow__(self, o): return self._op("**", o, lambda a, b: F.pow(a, b))  # noqa: E704
    def __neg__(self): return Expr("neg", (self,), lambda _, a: -a)  # noqa: E704
    def __eq__(self, o): return self._compared("==", o, lambda a, b: a == b)  # type: ignore[override]  # noqa: E704
    def __ne__(self, o): return self._compared("!=", o, lambda a, b: a != b)  # type: ignore[override]  # noqa: E704
    def __lt__(self, o): return self._compared("<", o, lambda a, b: a < b)  # noqa: E704
    def __le__(self, o): return self._compared("<=", o, lambda a, b: a <= b)  # noqa: E704
    def __gt__(self, o): return self._compared(">", o, lambda a, b: a > b)  # noqa: E704
    def __ge__(self, o): return self._compared(">=", o, lambda a, b: a >= b)  # noqa: E704
    def __and__(self, o): return self._op("&", o, lambda a, b: a & b)  # noqa: E704
    def __rand__(self, o): return self._back("&", o, lambda a, b: a & b)  # noqa: E704
    def __or__(self, o): return self._op("|", o, lambda a, b: a | b)  # noqa: E704
    def __ror__(self, o): return self._back("|", o, lambda a, b: a | b)  # noqa: E704
    def __xor__(self, o): return self._op("^", o, lambda a, b: (a & ~b) | (~a & b))  # noqa: E704
    def __invert__(self): return Expr("!", (self,), lambda _, a: ~a)  # noqa: E704

    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; combine with &, | and ~")

    def cast(self, kind: str) -> Expr:
        return Expr(f"cast_{kind}", (self,), lambda _, a: a.cast(kind))

    def isin(self, *values: Any) -> Expr:
        """Membership; never missing, and a missing value is found among missing ones."""
        given = values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set)) else values
        real = [v for v in given if v is not None]
        missing = len(real) < len(list(given))
        return Expr("isin", (self,), lambda _, a: F.coalesce(a.isin(real), F.lit(False)) | (a.isNull() if missing else F.lit(False)))

    def is_na(self) -> Expr:
        return Expr("is_na", (self,), lambda c, a: c.missing(a))

    def __repr__(self) -> str:
        return self.label if not self.children else f"{self.label}({', '.join(map(repr, self.children))})"


def divided(a: Column, b: Column) -> Column:
    """Floating division that follows IEEE 754 at zero."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(F.when(a.isNull(), None).otherwise(float("nan")))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


class Col(Expr):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name

    def build(self, context, *columns: Column) -> Column:
        return quoted(self.name)


class Lit(Expr):
    def __init__(self, value: Any):
        super().__init__(repr(value))
        self.value = value

    def build(self, context, *columns: Column) -> Column:
        if isinstance(self.value, datetime) and self.value.tzinfo is None:  # a wall-clock time in any session's zone
            return F.lit(self.value.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(self.value)


class Raw(Expr):
    """A Spark column taken as it is; what it reads is not known."""

    def __init__(self, column: Column):
        super().__init__("spark")
        self.column = column

    def build(self, context, *columns: Column) -> Column:
        return self.column


class Desc(Expr):
    """Reverses the order of a sort key or of the ranks of an argument."""

    def __init__(self, child: Any):
        super().__init__("desc", (child,), lambda _, a: a)


def as_expr(value: Any) -> Expr:
    if isinstance(value, Expr):
        return value
    return Raw(value) if isinstance(value, Column) else Lit(value)


def col(name: str) -> Col:
    """A column by name."""
    return Col(name)


def lit(value: Any) -> Lit:
    return Lit(value)


def desc(value: Any) -> Desc:
    return Desc(Col(value) if isinstance(value, str) else value)


def named(value: Any) -> Expr:
    """A string as a column, anything else as an expression."""
    return Col(value) if isinstance(value, str) else as_expr(value)
