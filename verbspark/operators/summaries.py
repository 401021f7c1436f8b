"""Verbs that aggregate."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expr import Desc, Expr, named, quoted
from ..plans.lower import Context, Summary, hidden, level_key
from ..plans.macros import expanded


class SummaryVerbs:
    def summarise(self, *given: Any, _by: Any = None, _groups: str | None = None, **named_: Any):
        """One row per group; later expressions see earlier results.

        Groups come in ascending order of their keys, those of a transient
        grouping in the order of their first rows.
        """
        from ..frame import Frame

        by = self._by(_by)
        if by is not None and _groups is not None:
            raise ValueError("a transient grouping leaves no groups")
        keys = list(self.groups if by is None else by)
        if self.is_rowwise:
            frame = self.transmute_rowwise(given, named_)
            return frame._with(frame._df, groups=[] if _groups == "drop" else keys, rowwise=_groups == "rowwise")
        context = Context(self._df, keys, self.order)
        if by is not None:
            context.known_order()
        summary = Summary(context, keys)
        parts = [(name, e) for name, e in expanded(self.fields, keys, given, named_) if e is not None]
        for name, e in parts:
            summary.add(name, e)
        extra = {}
        if by is not None and context.order and not any(x.alone for _, e in parts for x in e.walk()):
            extra[hidden("o")] = F.min(context.position())
        df = summary.frame(extra)
        order = [(n, False) for n in extra]
        if by is None and keys:
            names = [hidden("o") for _ in keys]
            df = df.withColumns({n: level_key(self.schema, k) for n, k in zip(names, keys)})
            order = [(n, False) for n in names]
        df = df.select(*(quoted(k) for k in keys if k not in summary.results), *(c.alias(n) for n, c in summary.results.items()), *(quoted(n) for n, _ in order))
        if not self.drop and by is None and keys:
            df = self._with_empty_groups(df, keys, [n for n, _ in order], summary)
        left = {None: keys[:-1], "drop_last": keys[:-1], "drop": [], "keep": keys, "rowwise": keys}
        if _groups not in left:
            raise ValueError(f"no such _groups: {_groups}")
        groups = [] if by is not None else left[_groups]
        return Frame(df, [g for g in groups if g in df.columns], order, _groups == "rowwise", self.drop)

    summarize = summarise

    def transmute_rowwise(self, given: tuple[Any, ...], named_: dict[str, Any]):
        out = self.mutate(*given, **named_)
        made = [n for n, _ in expanded(self.fields, list(self.groups), given, named_)]
        return out.select(*dict.fromkeys([*self.groups, *made]))

    def _with_empty_groups(self, df: DataFrame, keys: list[str], order: list[str], summary: Summary) -> DataFrame:
        """Adds rows for factor levels without rows: counts are 0 and sums too, anything else null.

        Levels expand key by key; under an empty branch a key that is no
        factor is null.
        """
        levels = {k: self._df.schema[k].metadata.get("levels") for k in keys}
        if not any(levels.values()):
            return df
        skeleton = None
        seen: list[str] = []
        for k in keys:
            if levels[k]:
                every = self.session.createDataFrame([(v,) for v in levels[k]], T.StructType([T.StructField(k, T.StringType())]))
                missing = df.select(quoted(k)).where(quoted(k).isNull()).distinct()
                level = every.union(missing) if skeleton is None else every
                skeleton = level if skeleton is None else skeleton.crossJoin(F.broadcast(level))
            else:
                here = df.select(*(quoted(x) for x in [*seen, k])).distinct()
                skeleton = here if skeleton is None else _null_safe_join(skeleton, here, seen, "left")
            seen.append(k)
        out = _null_safe_join(skeleton, df, keys, "left")
        zero = {n for n in summary.results if str(n)}
        filled = []
        for c in df.columns:
            if c in summary.results and c in zero and isinstance(df.schema[c].dataType, T.LongType):
                filled.append(F.coalesce(quoted(c), F.lit(0)).alias(c))
            elif c in order:
                filled.append(level_key(self.schema, keys[order.index(c)]).alias(c))
            else:
                filled.append(quoted(c))
        return out.select(*filled)

    def reframe(self, *given: Any, _by: Any = None, **named_: Any):
        """Any number of rows per group: arrays become rows, single values repeat."""
        from ..frame import Frame

        by = self._by(_by)
        keys = list(self.groups if by is None else by)
        if self.is_rowwise:
            out = self.transmute_rowwise(given, named_)
            df, order = out._df, list(out.order)
            names = [c for c in out.columns if c not in self.groups]
        else:
            context = Context(self._df, keys, self.order)
            context.known_order()
            summary = Summary(context, keys)
            for name, e in expanded(self.fields, keys, given, named_):
                summary.add(name, e)
            extra = {hidden("o"): F.min(context.position())} if by is not None and context.order else {}
            df = summary.frame(extra)
            order = [(n, False) for n in extra]
            if by is None:
                own = [hidden("o") for _ in keys]
                df = df.withColumns({n: quoted(k) for n, k in zip(own, keys)})
                order = [(n, False) for n in own]
            names = list(summary.results)
            df = df.select(*(quoted(k) for k in keys), *(c.alias(n) for n, c in summary.results.items()), *(quoted(n) for n, _ in order))
        arrays = [n for n in names if isinstance(df.schema[n].dataType, T.ArrayType)]
        if not arrays:
            return Frame(df, (), order)
        size = F.greatest(*(F.size(quoted(n)) for n in arrays), F.lit(0)) if len(arrays) > 1 else F.size(quoted(arrays[0]))
        if len(arrays) > 1:  # a length of 1 repeats, also to none
            least = F.least(*(F.size(quoted(n)) for n in arrays))
            size = F.when(least == 0, 0).otherwise(size)
            odd = reduce(and_, ((F.size(quoted(n)) == size) | (F.size(quoted(n)) == 1) for n in arrays))
            size = F.when(odd, size).otherwise(F.raise_error(F.lit("reframe(): lengths in a group differ")).cast("int"))
        place = hidden("o")
        rows = F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))).alias(place)
        df = df.select("*", rows)
        item = lambda n: F.get(quoted(n), F.when(F.size(quoted(n)) == 1, 0).otherwise(quoted(place))).alias(n)
        df = df.select(*(item(c) if c in arrays else quoted(c) for c in df.columns))
        return Frame(df, (), (*order, (place, False)))

    # counts

    def _count_name(self, taken: list[str], name: str | None) -> str:
        if name is not None:
            return name
        out = "n"
        while out in taken:
            out = "n" + out
        return out

    def _weight(self, wt: Any) -> Expr:
        from ..functions.aggregates import n, sum

        return n() if wt is None else sum(wt, na_rm=True)

    def count(self, *given: Any, _wt: Any = None, _sort: bool = False, _name: str | None = None, _drop: bool | None = None, **named_: Any):
        """Rows, or the sum of weights, of each combination of columns, in their order."""
        frame = self.group_by(*given, _add=True, _drop=_drop, **named_)
        return frame.tally(_wt, _sort, _name, own=list(self.groups))

    def tally(self, _wt: Any = None, _sort: bool = False, _name: str | None = None, own: list[str] | None = None):
        """Rows, or the sum of weights, of each group."""
        name = self._count_name(list(self.groups), _name)
        frame = self._with(self._df, rowwise=False) if self.is_rowwise else self
        out = frame.summarise(_groups="drop" if own is not None else None, **{name: self._weight(_wt)})
        if own is not None:
            out = out._with(out._df, groups=own)
        return out.arrange(Desc(named(name))) if _sort else out

    def add_count(self, *given: Any, _wt: Any = None, _sort: bool = False, _name: str | None = None, **named_: Any):
        """Every row with the size of its combination of columns."""
        frame = self.group_by(*given, _add=True, **named_)
        return frame.add_tally(_wt, _sort, _name)._regrouped(self)

    def add_tally(self, _wt: Any = None, _sort: bool = False, _name: str | None = None):
        name = self._count_name(self.columns, _name)
        out = self.mutate(**{name: self._weight(_wt)})
        return out.arrange(Desc(named(name))) if _sort else out

    def _regrouped(self, like):
        return self._with(self._df, groups=like.groups, rowwise=like.is_rowwise, drop=like.drop)

    def cube(self, *given: Any, **aggregates: Any):
        """Summaries over all subsets of some columns; beyond the verbs proper."""
        return self._grouping_sets("cube", given, aggregates)

    def rollup(self, *given: Any, **aggregates: Any):
        """Summaries over all leading parts of some columns; beyond the verbs proper."""
        return self._grouping_sets("rollup", given, aggregates)

    def _grouping_sets(self, kind: str, given: tuple[Any, ...], aggregates: dict[str, Any]):
        from ..frame import Frame

        frame, keys = self._computed(given)
        context = Context(frame._df, [], frame.order)
        summary = Summary(context, keys)
        for name, e in expanded(frame.fields, keys, [], aggregates):
            summary.add(name, e)
        df = getattr(context.df, kind)(*(quoted(k) for k in keys)).agg(*(c.alias(n) for n, c in summary.aggregates.items()))
        return Frame(df.select(*(quoted(k) for k in keys), *(c.alias(n) for n, c in summary.results.items())))


def _null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    other = {k: hidden() for k in keys}
    b = b.select(*(quoted(c).alias(other.get(c, c)) for c in b.columns))
    match: Column = reduce(and_, (quoted(k).eqNullSafe(quoted(n)) for k, n in other.items()), F.lit(True))
    return a.join(b, match, how).drop(*other.values())


