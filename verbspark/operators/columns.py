"""Verbs that change columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from ..plans.expr import Col, Expr, quoted
from ..plans.lower import is_hidden
from ..plans.macros import Macro, expanded
from ..plans.select import as_selector, everything, resolve


def _hidden(df: DataFrame) -> list:
    return [quoted(c) for c in df.columns if is_hidden(c)]


class ColumnVerbs:
    def select(self, *given: Any, **renamed: Any):
        """Columns by selection, or under new names; grouping columns always stay."""
        found = resolve(self.fields, list(self.groups), given, renamed)
        missing = [g for g in self.groups if g not in found.values()]
        chosen = {**{g: g for g in missing}, **found}
        return self._renamed(chosen)

    def _renamed(self, chosen: dict[str, str]):
        new = {old: n for n, old in chosen.items()}
        df = self._df.select(*(quoted(old).alias(n) for n, old in chosen.items()), *_hidden(self._df))
        return self._with(df, groups=[new[g] for g in self.groups])

    def rename(self, **renamed: Any):
        """New names for columns, which stay where they are."""
        found = resolve(self.fields, list(self.groups), [], renamed)
        new = {old: n for n, old in found.items()}
        return self._renamed_all([new.get(c, c) for c in self.columns])

    def rename_with(self, function: Callable[[str], str], columns: Any = None):
        """New names by a function of the old ones."""
        chosen = set(self._names(everything() if columns is None else columns))
        return self._renamed_all([function(c) if c in chosen else c for c in self.columns])

    def _renamed_all(self, names: list[str]):
        if len(set(names)) != len(names):
            raise ValueError("new names repeat")
        return self._renamed(dict(zip(names, self.columns)))

    def relocate(self, *given: Any, _before: Any = None, _after: Any = None, **renamed: Any):
        """Moves columns to the front, or before the first or after the last of others."""
        if _before is not None and _after is not None:
            raise ValueError("give _before or _after, not both")
        moved = resolve(self.fields, list(self.groups), given, renamed)
        order = self.columns
        at = 0
        if _before is not None:
            at = min(map(order.index, self._names(_before)))
        elif _after is not None:
            at = max(map(order.index, self._names(_after))) + 1
        rest = [(k, c) for k, c in enumerate(order) if c not in moved.values()]
        front = {c: c for k, c in rest if k < at}
        back = {c: c for k, c in rest if k >= at}
        return self._renamed({**front, **moved, **back})

    def mutate(self, *given: Any, _by: Any = None, _keep: str = "all", _before: Any = None, _after: Any = None, **named: Any):
        """New columns, each seeing those before it; None removes a column.

        Aggregates stand for their group's value in every row.
        """
        if _keep not in ("all", "used", "unused", "none"):
            raise ValueError('_keep is "all", "used", "unused" or "none"')
        by = self._by(_by)
        old, df, order = self.columns, self._df, self.order
        used: set[str] = set()
        made: list[str] = []
        frame = self
        for value in [*((None, g) for g in given), *named.items()]:
            name, v = value
            macro = isinstance(v, Macro)
            parts = expanded(frame.fields, list(by or self.groups), [v] if name is None else [], {} if name is None else {name: v})
            fixed = frame  # a macro's parts all see the columns before it
            for new, expr in parts:
                if expr is None:
                    frame = frame._with(frame._df.drop(new), order=order)
                    made = [m for m in made if m != new]
                    continue
                if not macro:
                    used |= expr.names()
                elif isinstance(expr, Expr):
                    used |= expr.names() & set(fixed.columns)
                context = frame._context(by)
                context.order = order
                column = context.build(expr)
                order = context.order
                frame = frame._with(context.df.withColumn(new, column), order=order)
                if new not in made:
                    made.append(new)
        df, order = frame._df, frame.order
        new_names = [m for m in made if m not in old]
        if _before is not None or _after is not None:
            if new_names:
                frame = frame.relocate(*new_names, _before=_before, _after=_after)
        if _keep != "all":
            groups = set(by or self.groups)
            keep = {"used": lambda c: c in used, "unused": lambda c: c not in used, "none": lambda c: False}[_keep]
            frame = frame.select(*(c for c in frame.columns if c in made or c in groups or (c in old and keep(c))))
        return frame

    def transmute(self, *given: Any, **named: Any):
        """Only the grouping columns and the new ones, in the order of the call."""
        out = self.mutate(*given, **named)
        names = [n for n, e in [*(p for g in given for p in expanded(self.fields, list(self.groups), [g])), *((n, v) for n, v in named.items())] if e is not None]
        return out.select(*dict.fromkeys(n for n in names if n in out.columns))

    def pull(self, column: Any = -1, name: Any = None):
        """One column's values in row order, or a dict of them by another column."""
        chosen = as_selector(column).find(self.fields, list(self.groups))
        if len(chosen) != 1:
            raise ValueError("pull() takes one column")
        rows = self.ordered().select(quoted(chosen[0]).alias("v"), *([quoted(self._names(name)[0]).alias("k")] if name is not None else [])).collect()
        return {r.k: r.v for r in rows} if name is not None else [r.v for r in rows]

    def _expressions(self, given: tuple[Any, ...], named: dict[str, Any] | None = None, by: list[str] | None = None) -> list[tuple[str, Expr]]:
        return expanded(self.fields, list(self.groups if by is None else by), given, named)

    def _computed(self, given: tuple[Any, ...], named: dict[str, Any] | None = None):
        """The frame with computed columns added, and the names meant; evaluated without groups."""
        frame, names = self._with(self._df, groups=(), rowwise=False), []
        for name, expr in expanded(self.fields, [], given, named):
            if not (isinstance(expr, Col) and expr.name == name):
                frame = frame.mutate(**{name: expr})
            names.append(name)
        return frame, list(dict.fromkeys(names))
