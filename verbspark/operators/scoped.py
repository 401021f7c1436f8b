"""Older verbs for all columns, columns that pass a test, or named columns.

Each is a thin wrapper of its verb over across() or pick().  Functions may be
one, a list or a dict; results of several are named function by function.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import and_, or_
from typing import Any

from ..plans.expr import Col, Expr
from ..plans.macros import Across, Quantified
from ..plans.select import as_selector, everything, where


class AllVars:
    """A test that must hold for every column."""

    def __init__(self, test: Callable[[Expr], Any], every: bool = True):
        self.test, self.every = test, every


def all_vars(test: Callable[[Expr], Any]) -> AllVars:
    return AllVars(test, True)


def any_vars(test: Callable[[Expr], Any]) -> AllVars:
    return AllVars(test, False)


def vars_(*given: Any):
    """A selection for the _at verbs."""
    return as_selector(list(given))


def _columns(kind: str, chosen: Any):
    if kind == "all":
        return everything()
    return where(chosen) if kind == "if" else as_selector(chosen)


def _names(functions: Any, count: int) -> str | None:
    if isinstance(functions, (list, tuple, dict)) and len(functions) > 1:
        return "{fn}" if count == 1 else "{col}_{fn}"
    if isinstance(functions, dict):
        return "{fn}" if count == 1 else "{col}_{fn}"
    return "{col}"


class ScopedVerbs:
    def _scoped(self, verb: str, kind: str, chosen: Any, functions: Any):
        groups = () if verb == "select" else self.groups
        columns = _columns(kind, chosen)
        free = [f for f in self.fields if f.name not in groups]
        count = len(columns.find(free, list(self.groups)))
        return getattr(self, verb)(Across(columns, functions, _names(functions, count), function_major=True))

    def _renaming(self, kind: str, chosen: Any, function: Callable[[str], str] | None, keep_all: bool):
        names = _columns(kind, chosen).find(self.fields, list(self.groups))
        out = self if keep_all else self.select(*names)
        return out.rename_with(function, [n for n in names if n in out.columns]) if function is not None else out

    def _picked(self, verb: str, kind: str, chosen: Any, function: Callable[[Expr], Any] | None, **more: Any):
        names = _columns(kind, chosen).find(self.fields, list(self.groups))
        if function is None:
            return getattr(self, verb)(*names, **more)
        if verb == "arrange":
            return self.arrange(*(function(Col(n)) for n in names), **more)
        return getattr(self, verb)(**{n: function(Col(n)) for n in names}, **more)

    def _tested(self, kind: str, chosen: Any, test: AllVars):


        return self.filter(Quantified(_columns(kind, chosen), test.test, and_ if test.every else or_, test.every, all_columns=True))

    def filter_all(self, test: AllVars):
        return self._tested("all", None, test)

    def filter_if(self, chosen: Any, test: AllVars):
        return self._tested("if", chosen, test)

    def filter_at(self, chosen: Any, test: AllVars):
        return self._tested("at", chosen, test)


def _add_verbs() -> None:
    """Adds the _all, _if and _at forms of the verbs that take functions of columns."""

    def add(name: str, method: Callable, text: str) -> None:
        method.__name__, method.__doc__ = name, text
        setattr(ScopedVerbs, name, method)

    for verb in ("mutate", "transmute", "summarise", "summarize"):
        target = "summarise" if verb == "summarize" else verb
        add(f"{verb}_all", lambda self, functions, t=target: self._scoped(t, "all", None, functions), f"{target}() of every column.")
        for kind in ("if", "at"):
            add(f"{verb}_{kind}", lambda self, chosen, functions, t=target, k=kind: self._scoped(t, k, chosen, functions), f"{target}() of chosen columns.")
    for verb in ("arrange", "distinct", "group_by"):
        add(f"{verb}_all", lambda self, function=None, v=verb, **more: self._picked(v, "all", None, function, **more), f"{verb}() by every column.")
        for kind in ("if", "at"):
            add(f"{verb}_{kind}", lambda self, chosen, function=None, v=verb, k=kind, **more: self._picked(v, k, chosen, function, **more), f"{verb}() by chosen columns.")
    for verb, keep in (("select", False), ("rename", True)):
        add(f"{verb}_all", lambda self, function=None, keep=keep: self._renaming("all", None, function, keep), f"{verb}() of every column by a function of its name.")
        for kind in ("if", "at"):
            add(f"{verb}_{kind}", lambda self, chosen, function=None, k=kind, keep=keep: self._renaming(k, chosen, function, keep), f"{verb}() of chosen columns by a function of their names.")


_add_verbs()

