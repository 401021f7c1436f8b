"""Selections of columns, resolved against a schema."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import types as T

from .expr import Col

Fields = list[T.StructField]


class Selector:
    """A set of columns in order; combines with &, | and ~."""

    def __init__(self, find: Callable[[Fields, list[str]], list[str]]):
        self.find = find

    def __or__(self, other: Any) -> Selector:
        o = as_selector(other)
        return Selector(lambda fields, groups: list(dict.fromkeys([*self.find(fields, groups), *o.find(fields, groups)])))

    def __and__(self, other: Any) -> Selector:
        o = as_selector(other)
        return Selector(lambda fields, groups: [n for n in self.find(fields, groups) if n in set(o.find(fields, groups))])

    def __invert__(self) -> Selector:
        return Selector(lambda fields, groups: [f.name for f in fields if f.name not in set(self.find(fields, groups))])

    def __sub__(self, other: Any) -> Selector:
        return self & ~as_selector(other)


def _by_name(test: Callable[[str], bool]) -> Selector:
    return Selector(lambda fields, _: [f.name for f in fields if test(f.name)])


def _any_of(match: str | Iterable[str], test: Callable[[str, str], bool], ignore_case: bool) -> Selector:
    wanted = [match] if isinstance(match, str) else list(match)
    fold = str.lower if ignore_case else str
    return _by_name(lambda n: any(test(fold(n), fold(w)) for w in wanted))


def starts_with(match: str | Iterable[str], ignore_case: bool = True) -> Selector:
    return _any_of(match, str.startswith, ignore_case)


def ends_with(match: str | Iterable[str], ignore_case: bool = True) -> Selector:
    return _any_of(match, str.endswith, ignore_case)


def contains(match: str | Iterable[str], ignore_case: bool = True) -> Selector:
    return _any_of(match, str.__contains__, ignore_case)


def matches(pattern: str, ignore_case: bool = True) -> Selector:
    found = re.compile(pattern, re.I if ignore_case else 0)
    return _by_name(lambda n: found.search(n) is not None)


def num_range(prefix: str, numbers: Iterable[int], width: int = 0) -> Selector:
    names = [f"{prefix}{n:0{width}d}" for n in numbers]
    return Selector(lambda fields, _: [n for n in names if n in {f.name for f in fields}])


def all_of(names: Iterable[str]) -> Selector:
    wanted = list(names)

    def find(fields: Fields, _: list[str]) -> list[str]:
        known = {f.name for f in fields}
        if unknown := [n for n in wanted if n not in known]:
            raise KeyError(f"no such columns: {', '.join(unknown)}")
        return wanted

    return Selector(find)


def any_of(names: Iterable[str]) -> Selector:
    wanted = list(names)
    return Selector(lambda fields, _: [n for n in wanted if n in {f.name for f in fields}])


one_of = any_of


def everything() -> Selector:
    return _by_name(lambda _: True)


def last_col(offset: int = 0) -> Selector:
    return Selector(lambda fields, _: [fields[-1 - offset].name])


def span(first: str, last: str) -> Selector:
    """All columns from one to another, in either direction."""

    def find(fields: Fields, groups: list[str]) -> list[str]:
        names = [f.name for f in fields]
        all_of([first, last]).find(fields, groups)
        a, b = names.index(first), names.index(last)
        return names[a : b + 1] if a <= b else names[b : a + 1][::-1]

    return Selector(find)


def where(test: Callable[[T.DataType], bool]) -> Selector:
    """Columns whose type passes a test."""
    return Selector(lambda fields, _: [f.name for f in fields if test(f.dataType)])


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_character(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_logical(kind: T.DataType) -> bool:
    return isinstance(kind, T.BooleanType)


def group_cols() -> Selector:
    return Selector(lambda _, groups: list(groups))


def as_selector(value: Any) -> Selector:
    if isinstance(value, Selector):
        return value
    if isinstance(value, Col):
        return all_of([value.name])
    if isinstance(value, str):
        return all_of([value])
    if isinstance(value, int):

        def at(fields: Fields, _: list[str]) -> list[str]:
            if value == 0 or abs(value) > len(fields):
                raise IndexError(f"there is no column {value}")
            return [fields[value - 1 if value > 0 else value].name]

        return Selector(at)
    if callable(value):
        return where(value)
    if isinstance(value, (list, tuple, set)):
        parts = [as_selector(v) for v in value]
        return Selector(lambda fields, groups: list(dict.fromkeys(n for p in parts for n in p.find(fields, groups))))
    raise TypeError(f"{value!r} selects no columns")


def resolve(fields: Fields, groups: list[str], given: Iterable[Any], renamed: dict[str, Any] | None = None) -> dict[str, str]:
    """New names and the columns they stand for, in order; a later new name for a column wins."""
    out: dict[str, str] = {}
    old: dict[str, str] = {}
    for name, value in [*((None, g) for g in given), *(renamed or {}).items()]:
        found = as_selector(value).find(fields, groups)
        for k, source in enumerate(found):
            new = source if name is None else name if len(found) == 1 else f"{name}{k + 1}"
            if source in old:
                if name is None:
                    continue
                out = {new if n == old[source] else n: s for n, s in out.items()}
            else:
                if new in out:
                    raise ValueError(f"two columns would be named {new}")
                out[new] = source
            old[source] = new
    return out
