"""Verbs that keep, order or draw rows."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.expr import ROW, Desc, Expr, as_expr, named, quoted
from ..plans.lower import Context, hidden, sort_columns
from ..plans.macros import Macro, expanded


#: Rows of a sample that are drawn as a limit, and bins that draws of larger ones are counted in.
LIMIT_ROWS, DRAW_BINS = 100_000, 65_536


class RowVerbs:
    def filter(self, *conditions: Any, _by: Any = None):
        """Rows for which all conditions are true."""
        return self._filtered(conditions, _by, lambda c: c)

    def filter_out(self, *conditions: Any, _by: Any = None):
        """Drops the rows for which all conditions are true; missing ones stay."""
        return self._filtered(conditions, _by, lambda c: ~F.coalesce(c, F.lit(False)))

    def _filtered(self, conditions: tuple[Any, ...], by: Any, change):
        by = self._by(by)
        context = self._context(by)
        tests = []
        for _, e in expanded(self.fields, list(by or self.groups), conditions):
            column = context.build(e)
            tests.append(context.settled(column) if any(x.kind != ROW for x in e.walk()) else column)
        if not tests:
            return self
        return self._with(context.df.filter(change(reduce(and_, tests))), order=context.order)

    def arrange(self, *keys: Any, _by_group: bool = False, _locale: str | None = None):
        """Sorts rows; stable, missing values last also in descending order."""
        context = Context(self._df, [], self.order)
        context.known_order()
        parts: list[Expr] = []
        for k in [*(self.groups if _by_group else ()), *keys]:
            parts += [e for _, e in expanded(self.fields, [], [k])] if isinstance(k, Macro) else [k if isinstance(k, Desc) else named(k)]
        added = []
        for e in parts:
            column, down = context.sort_key(e)
            if _locale is not None and _locale != "C" and context.type_of(column).typeName() == "string":
                column = F.collate(column, _locale)
            name = hidden("o")
            context.df = context.df.withColumn(name, column)
            added.append((name, down))
        return self._with(context.df, order=(*added, *context.order))

    # slices

    def _size(self, n: int | None, prop: float | None, rows: Column) -> Column:
        if n is not None and prop is not None:
            raise ValueError("give n or prop, not both")
        if prop is not None:
            wanted = F.floor(rows * F.lit(float(prop))) if prop >= 0 else F.ceil(rows + rows * F.lit(float(prop)))
        else:
            n = 1 if n is None else n
            wanted = F.lit(math.floor(n)) if n >= 0 else rows + math.ceil(n)
        return F.greatest(F.least(wanted.cast("long"), rows), F.lit(0).cast("long"))

    def _group_context(self, by: Any) -> tuple[Context, list[str]]:
        by = self._by(by)
        context = self._context(by)
        context.known_order()
        if self.is_rowwise:
            name = hidden()
            row = F.struct(*sort_columns_or_id(context))
            context.df = context.df.withColumn(name, row)
            context.groups = [name]
        return context, list(self.groups if by is None else by)

    def _grouped_order(self, context: Context, groups: list[str], place: str, order) -> tuple:
        """Rows by group, then by place."""
        named_groups = []
        for g in groups:
            name = hidden("o")
            context.df = context.df.withColumn(name, quoted(g))
            named_groups.append((name, False))
        return (*named_groups, (place, False), *order)

    def slice(self, *positions: Any, _by: Any = None):
        """Rows by their place in their group: positive ones are taken, repeats included, negative ones dropped."""
        context, groups = self._group_context(_by)
        given = [p for q in positions for p in (q if isinstance(q, (list, tuple, range)) else [q])]
        if any(isinstance(p, (str, bool)) for p in given):
            raise TypeError("positions are numbers")
        number = context.settled(F.row_number().over(context.window()))
        if not given:
            return self._with(context.df.filter(F.lit(False)))
        signs = {math.copysign(1, p) for p in given if isinstance(p, (int, float)) and p}
        if len(signs) > 1:
            raise ValueError("positions are all positive or all negative")
        if signs == {-1.0}:
            out = [-math.trunc(p) for p in given if p]
            context.df = context.df.filter(~number.isin(out))
            order = self._grouped_order(context, groups, _name(context, number), context.order) if groups else context.order
            return self._with(context.df, order=order)
        if all_numbers(given):  # a limit that Spark applies before the shuffle
            context.df = context.df.filter(number <= max(math.trunc(p or 0) for p in given))
        places = F.array(*(F.struct(F.lit(k).alias("slot"), (context.build(as_expr(p)) if isinstance(p, Expr) else F.lit(None if p is None else math.trunc(p))).cast("long").alias("at")) for k, p in enumerate(given)))
        slots = F.transform(F.filter(places, lambda s: s["at"] == number), lambda s: s["slot"])
        name = hidden("o")
        context.df = context.df.withColumn(name, F.explode(slots))
        order = self._grouped_order(context, groups, name, context.order)
        return self._with(context.df, order=order)

    def _ends(self, n: int | None, prop: float | None, by: Any, tail: bool):
        frame = self.with_order()
        if prop is None and (n is None or n >= 0) and by is None and not self.groups and not self.is_rowwise and frame.order:
            backwards = [F.asc_nulls_first(quoted(c)) if down else F.desc_nulls_first(quoted(c)) for c, down in frame.order]
            return frame._with(frame._df.orderBy(*(backwards if tail else sort_columns(frame.order))).limit(1 if n is None else math.floor(n)))
        context, groups = self._group_context(by)
        spec = context.window()
        number = context.settled(F.row_number().over(spec))
        whole = Window.partitionBy(*(quoted(g) for g in context.groups))
        if prop is None and not tail and (n is None or n >= 0):
            keep = number <= (1 if n is None else math.floor(n))
        else:
            rows = context.settled(F.count(F.lit(1)).over(whole))
            size = self._size(n, prop, rows)
            keep = number > rows - size if tail else number <= size
        context.df = context.df.filter(keep)
        order = self._grouped_order(context, groups, _name(context, number), context.order)
        return self._with(context.df, order=order)

    def slice_head(self, n: int | None = None, prop: float | None = None, _by: Any = None):
        return self._ends(n, prop, _by, False)

    def slice_tail(self, n: int | None = None, prop: float | None = None, _by: Any = None):
        return self._ends(n, prop, _by, True)

    def _extreme(self, key: Any, n: int | None, prop: float | None, by: Any, with_ties: bool, na_rm: bool, down: bool):
        context, groups = self._group_context(by)
        parts = [e for _, e in expanded(self.fields, groups, [key])] if isinstance(key, Macro) else [named(k) for k in (key if isinstance(key, (list, tuple)) else [key])]
        columns = [context.settled(context.without_nan(context.build(e))) for e in parts]
        missing = reduce(lambda a, b: a | b, (c.isNull() for c in columns))
        sort = [missing.asc(), *((F.desc_nulls_last(c) if down else F.asc_nulls_last(c)) for c in columns)]
        if not with_ties and prop is None and (n is None or n >= 0) and not context.groups:
            context.row_order()
            df, order = context.df.filter(~missing) if na_rm else context.df, context.order
            names = [hidden("o") for _ in sort]
            keyed = df.withColumns(dict(zip(names, [missing, *columns])))
            keyed_order = [(names[0], False), *((m, down) for m in names[1:])]
            return self._with(keyed.orderBy(*sort_columns([*keyed_order, *order])).limit(1 if n is None else math.floor(n)), order=(*keyed_order, *order))
        spec = context.window(sort, ties=with_ties)
        rank = context.settled((F.rank() if with_ties else F.row_number()).over(spec))
        if prop is None and (n is None or n >= 0):
            keep = rank <= (1 if n is None else math.floor(n))
        else:
            keep = rank <= self._size(n, prop, F.count(F.lit(1)).over(Window.partitionBy(*(quoted(g) for g in context.groups))))
            keep = context.settled(keep)
        context.df = context.df.filter(keep & ~missing if na_rm else keep)
        order = self._grouped_order(context, groups, _name(context, rank), context.order)
        return self._with(context.df, order=order)

    def slice_min(self, order_by: Any, n: int | None = None, prop: float | None = None, _by: Any = None, with_ties: bool = True, na_rm: bool = False):
        """The rows with the smallest values, by rank; missing values come last."""
        return self._extreme(order_by, n, prop, _by, with_ties, na_rm, False)

    def slice_max(self, order_by: Any, n: int | None = None, prop: float | None = None, _by: Any = None, with_ties: bool = True, na_rm: bool = False):
        """The rows with the largest values, by rank; missing values come last."""
        return self._extreme(order_by, n, prop, _by, with_ties, na_rm, True)

    def slice_sample(self, n: int | None = None, prop: float | None = None, _by: Any = None, weight_by: Any = None, replace: bool = False, seed: int = 0):
        """Random rows; weights are drawn without replacement by exponential keys, smallest first."""
        context, groups = self._group_context(_by)
        weight = context.settled(context.build(named(weight_by))) if weight_by is not None else F.lit(1.0)
        partition = Window.partitionBy(*(quoted(g) for g in context.groups))
        if not replace:
            draw = context.settled(F.when(weight > 0, -F.log(F.lit(1.0) - F.rand(seed)) / weight).otherwise(F.lit(float("inf"))))
            if not context.groups:
                return self._drawn(context, draw, n, prop)
            number = context.settled(F.row_number().over(partition.orderBy(draw)))
            rows = context.settled(F.count(F.lit(1)).over(partition))
            keep = number <= self._size(n, prop, rows)
            context.df = context.df.filter(keep)
            order = self._grouped_order(context, groups, _name(context, number), context.order)
            return self._with(context.df, order=order)
        # Each draw is a point on the group's line of weights; the row whose stretch holds it is drawn.
        upto, total = hidden(), hidden()
        spec = partition.orderBy(*context.row_order())
        df = context.df.withColumns({upto: F.sum(weight).over(spec.rowsBetween(Window.unboundedPreceding, 0)), total: F.sum(weight).over(partition)})
        keys = [quoted(g) for g in context.groups]
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.first(total).alias("__all"))
        wanted = (F.floor(quoted("__rows") * F.lit(float(prop))) if prop is not None else F.lit(1 if n is None else math.floor(n))).cast("long")
        slot, point = hidden("o"), hidden()
        draws = sizes.where(wanted > 0).select(*(k.alias(f"__g{i}") for i, k in enumerate(keys)), "__all", F.explode(F.sequence(F.lit(1).cast("long"), wanted)).alias(slot))
        draws = draws.withColumn(point, F.rand(seed) * quoted("__all"))
        match = reduce(and_, [(quoted(point) < quoted(upto)) & (quoted(point) >= quoted(upto) - weight), *(k.eqNullSafe(quoted(f"__g{i}")) for i, k in enumerate(keys))])
        context.df = df.join(draws, match).drop(*(f"__g{i}" for i in range(len(keys))), "__all")
        order = self._grouped_order(context, groups, slot, context.order)
        return self._with(context.df, order=order)

    def _drawn(self, context: Context, draw: Column, n: int | None, prop: float | None):
        """The rows of a whole table with the smallest draws.

        Few are a limit.  Many are found through a count of draws by bins: bins
        below the limit are taken whole, and only the bin at the limit is
        numbered, so that no task sees all rows.
        """
        place = _name(context, draw)
        order = ((place, False), *context.order)
        if prop is None and 0 <= (1 if n is None else n) <= LIMIT_ROWS:
            return self._with(context.df.orderBy(quoted(place)).limit(1 if n is None else math.floor(n)), order=order)
        bin_, rows, upto, whole, number = (hidden() for _ in range(5))
        drawn = context.df.withColumn(bin_, F.floor(F.lit(DRAW_BINS) * (1 - F.exp(-quoted(place)))))
        before = Window.partitionBy().orderBy(bin_).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per bin
        sizes = drawn.groupBy(bin_).agg(F.count(F.lit(1)).alias(rows))
        sizes = sizes.withColumns({upto: F.sum(rows).over(before), whole: F.sum(rows).over(Window.partitionBy())})
        sizes = sizes.select(F.col(bin_).alias(hidden("k")), (self._size(n, prop, F.col(whole)) - F.col(upto) + F.col(rows)).alias(upto), rows).where(F.col(upto) > 0)
        key = sizes.columns[0]
        near = drawn.join(F.broadcast(sizes), F.col(bin_) == F.col(key))
        near = near.withColumn(number, F.row_number().over(Window.partitionBy(bin_).orderBy(quoted(place))))
        return self._with(near.where(F.col(number) <= F.col(upto)), order=order)

    def sample_n(self, size: int, replace: bool = False, weight: Any = None, seed: int = 0):
        """As slice_sample(), but more rows than there are is an error."""
        if not replace:
            counts = self._df.groupBy(*(quoted(g) for g in self.groups)).count() if self.groups else self._df.agg(F.count(F.lit(1)).alias("count"))
            if not counts.where(F.col("count") < size).isEmpty():
                raise ValueError(f"a group has fewer than {size} rows")
        return self.slice_sample(n=size, weight_by=weight, replace=replace, seed=seed)

    def sample_frac(self, size: float = 1.0, replace: bool = False, weight: Any = None, seed: int = 0):
        """A share of the rows, rounded."""
        if size > 1 and not replace:
            raise ValueError("a share over 1 needs replacement")
        return self.slice_sample(prop=size, weight_by=weight, replace=replace, seed=seed)

    def _top(self, n: int | None, prop: float | None, wt: Any):
        context, _ = self._group_context(None)
        value = context.settled(context.without_nan(context.build(named(self.columns[-1] if wt is None else wt))))
        down = (n if n is not None else prop) >= 0
        missing = value.isNull()
        spec = context.window([F.desc_nulls_last(value) if down else F.asc_nulls_last(value)], ties=True)
        rank = context.settled(F.rank().over(spec))
        if prop is not None:
            known = F.count(F.lit(1)).over(Window.partitionBy(*(quoted(g) for g in context.groups)))
            limit = context.settled(F.floor(known * abs(prop)))
        else:
            limit = F.lit(abs(n))
        return self._with(context.df.filter((rank <= limit) & ~missing), order=context.order)

    def top_n(self, n: int, wt: Any = None):
        """The n largest, or for negative n smallest, rows with ties, in input order."""
        return self._top(n, None, wt)

    def top_frac(self, prop: float, wt: Any = None):
        return self._top(None, prop, wt)

    def distinct(self, *given: Any, _keep_all: bool = False, **named_: Any):
        """Different rows, or the first row of each combination of some columns."""
        frame, names = self._computed(given, named_)
        names = list(dict.fromkeys([*self.groups, *names])) if names else frame.columns
        keys = [quoted(c) for c in names]
        if _keep_all:
            context = Context(frame._df, names, frame.order)
            number = context.settled(F.row_number().over(context.window()))
            return self._with(context.df.filter(number == 1), order=context.order)
        frame = frame.with_order()
        if not frame.order:
            return self._with(frame._df.select(*keys).distinct(), order=())
        context = Context(frame._df, [], frame.order)
        place = hidden("o")
        df = context.df.groupBy(*keys).agg(F.min(context.position()).alias(place))
        return self._with(df, order=((place, False),))


def sort_columns_or_id(context: Context) -> list[Column]:
    context.row_order()
    return [quoted(n) for n, _ in context.order]


def all_numbers(values) -> bool:
    return all(p is None or isinstance(p, (int, float)) for p in values)


def _name(context: Context, column: Column) -> str:
    """A hidden order column with these values."""
    name = hidden("o")
    context.df = context.df.withColumn(name, column)
    return name


