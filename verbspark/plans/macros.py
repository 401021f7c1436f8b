"""Expressions over several columns, expanded when a verb knows the schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_
from typing import Any

from .expr import Col, Expr, Lit, as_expr
from .select import Fields, everything, resolve


class Macro:
    """Stands for some named expressions."""

    def expand(self, fields: Fields, groups: list[str]) -> list[tuple[str, Expr]]:
        raise NotImplementedError


class Pick(Macro):
    def __init__(self, given: tuple[Any, ...]):
        if not given:
            raise ValueError("pick() takes at least one selection")
        self.given = given

    def expand(self, fields: Fields, groups: list[str]) -> list[tuple[str, Expr]]:
        free = [f for f in fields if f.name not in groups]
        return [(new, Col(old)) for new, old in resolve(free, groups, self.given).items()]


class Across(Macro):
    """Functions applied to columns; column by column, or function by function."""

    def __init__(self, columns: Any, functions: Any, names: str | None, function_major: bool = False, all_columns: bool = False):
        self.columns, self.names, self.function_major, self.all_columns = columns, names, function_major, all_columns
        self.several = isinstance(functions, (dict, list, tuple))
        if isinstance(functions, dict):
            self.functions = dict(functions)
        elif self.several:
            self.functions = {str(i): f for i, f in enumerate(functions, 1)}
        else:
            self.functions = {"": functions}

    def expand(self, fields: Fields, groups: list[str]) -> list[tuple[str, Expr]]:
        free = fields if self.all_columns else [f for f in fields if f.name not in groups]
        found = resolve(free, groups, [self.columns])
        names = self.names or ("{col}_{fn}" if self.several else "{col}")
        pairs = [(c, f) for f in self.functions for c in found] if self.function_major else [(c, f) for c in found for f in self.functions]
        out = []
        for new, f in pairs:
            value = self.functions[f](Col(found[new])) if self.functions[f] is not None else Col(found[new])
            name = names.replace("{col}", new).replace("{fn}", f or "1")
            if isinstance(value, dict):  # several results of one function
                out += [(f"{name}_{inner}", _at_column(as_expr(e), found[new])) for inner, e in value.items()]
            else:
                out.append((name, _at_column(as_expr(value), found[new])))
        if len({n for n, _ in out}) < len(out):
            raise ValueError("across() makes equal names")
        return [(name, e if e is None else _resolved(e, fields, groups)) for name, e in out]


class Quantified(Macro):
    def __init__(self, columns: Any, test: Callable[[Expr], Any], join, empty: bool, all_columns: bool = False):
        self.columns, self.test, self.join, self.empty, self.all_columns = columns, test, join, empty, all_columns

    def expand(self, fields: Fields, groups: list[str]) -> list[tuple[str, Expr]]:
        free = fields if self.all_columns else [f for f in fields if f.name not in groups]
        tests = [as_expr(self.test(Col(c))) for c in resolve(free, groups, [self.columns]).values()]
        return [("", reduce(self.join, tests) if tests else Lit(self.empty))]


class CAcross(Expr):
    """Selected columns of each row as one array, resolved where the expression is used."""

    def __init__(self, columns: Any):
        super().__init__("c_across")
        self.columns = columns


def c_across(columns: Any = None) -> CAcross:
    """Columns of each row, never grouping columns, as one array."""
    return CAcross(everything() if columns is None else columns)


class CurColumn(Expr):
    """The name of the column that across() is at."""

    def __init__(self):
        super().__init__("cur_column", (), self._outside)

    @staticmethod
    def _outside(*_: Any):
        raise ValueError("cur_column() has a meaning inside across() only")


def cur_column() -> CurColumn:
    """The name of the current column of across(), as a text."""
    return CurColumn()


def _at_column(e: Expr, name: str) -> Expr:
    if isinstance(e, CurColumn):
        return Lit(name)
    return e.with_children(_at_column(c, name) for c in e.children) if any(isinstance(x, CurColumn) for x in e.walk()) else e


def _resolved(e: Expr, fields: Fields, groups: list[str]) -> Expr:
    if isinstance(e, CAcross):
        from ..functions.scalars import c_array

        free = [f for f in fields if f.name not in groups]
        return c_array(*(Col(c) for c in resolve(free, groups, [e.columns]).values()))
    if not any(isinstance(x, CAcross) for x in e.walk()):
        return e
    return e.with_children(_resolved(c, fields, groups) for c in e.children)


def pick(*given: Any) -> Pick:
    """Some columns, never grouping columns."""
    return Pick(given)


def across(columns: Any = None, functions: Any = None, names: str | None = None) -> Across:
    """A function, or a list or dict of functions, of each column; names has {col} and {fn}.

    A function may return a dict, whose results become columns of their own.
    The column's name is the argument's `name`.
    """
    return Across(everything() if columns is None else columns, functions, names)


def if_any(columns: Any, test: Callable[[Expr], Any]) -> Quantified:
    return Quantified(columns, test, or_, False)


def if_all(columns: Any, test: Callable[[Expr], Any]) -> Quantified:
    return Quantified(columns, test, and_, True)


def expanded(fields: Fields, groups: list[str], given: Iterable[Any], named: dict[str, Any] | None = None) -> list[tuple[str, Expr | None]]:
    """Names and expressions in order; a macro may stand for several, None for no value."""
    out: list[tuple[str, Expr | None]] = []
    for value in given:
        if isinstance(value, Macro):
            out += value.expand(fields, groups)
        elif isinstance(value, str):
            out.append((value, Col(value)))
        else:
            e = as_expr(value)
            out.append((e.name if isinstance(e, Col) else repr(e), e))
    for name, value in (named or {}).items():
        if isinstance(value, Macro):
            parts = value.expand(fields, groups)
            if len(parts) == 1:
                out.append((name, parts[0][1]))
            else:
                from ..functions.scalars import struct_of

                out.append((name, struct_of(dict(parts))))
        else:
            out.append((name, None if value is None else as_expr(value)))
    return [(name, e if e is None else _resolved(e, fields, groups)) for name, e in out]
