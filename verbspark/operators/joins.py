"""Joins by equality, inequality, range and nearest value, with cardinality contracts."""

from __future__ import annotations

import warnings
from functools import reduce
from operator import and_
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expr import quoted
from ..plans.joinspec import Condition, JoinSpec, as_join_spec
from ..plans.lower import Order, hidden, sort_columns

_RELATIONSHIPS = (None, "one-to-one", "one-to-many", "many-to-one", "many-to-many", "warn-many-to-many")
#: Ranges that the values of a nearest join without an equality are cut into.
_RANGES = 64
_MULTIPLE = ("all", "any", "first", "last")


def suffixed(names: list[str], others: list[str], suffix: str, first: list[str] = ()) -> list[str]:
    """Names with the suffix appended until they differ from the others and from each other."""
    out: list[str] = []
    taken = set(others) | set(first)
    for n in names:
        while suffix and (n in taken or n in out):
            n += suffix
        out.append(n)
    return out


def common_key_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type both keys are cast to, None if they agree; incompatible types are an error."""
    if a == b:
        return None
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            return T.DecimalType(38, 10)
        return T.DoubleType() if T.DoubleType() in (a, b) or T.FloatType() in (a, b) else T.LongType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampType}:
        return T.TimestampType()
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    raise TypeError(f"keys of incompatible types: {a.simpleString()} and {b.simpleString()}")


class _Sides:
    """Both tables of a join, the right one's columns renamed so that all names differ."""

    def __init__(self, x, y, spec: JoinSpec, na_matches: str):
        self.x, self.y, self.spec, self.na = x, y, spec, na_matches
        self.left, self.left_order = _ordered(x)
        right, right_order = _ordered(y)
        self.names = {c: hidden("y") for c in right.columns}
        self.right = right.select(*(quoted(c).alias(n) for c, n in self.names.items()))
        self.right_order: Order = tuple((self.names[n], down) for n, down in right_order)
        self.keys: list[tuple[Condition, str, str]] = []
        for c in spec.conditions:
            for name, frame, side in ((c.x, x, "left"), (c.y, y, "right")):
                if name not in frame.columns:
                    raise KeyError(f"no such column in the {side} table: {name}")
            a, b = self.left.schema[c.x].dataType, self.right.schema[self.names[c.y]].dataType
            kind = common_key_type(a, b)
            lk, rk = quoted(c.x), quoted(self.names[c.y])
            if kind is not None:
                lk, rk = lk.cast(kind), rk.cast(kind)
            if na_matches == "never" and isinstance(kind or a, (T.DoubleType, T.FloatType)):
                lk, rk = (F.when(~F.isnan(k), k) for k in (lk, rk))
            left_key, right_key = hidden("k"), hidden("k")
            self.left = self.left.withColumn(left_key, lk)
            self.right = self.right.withColumn(right_key, rk)
            self.keys.append((c, left_key, right_key))

    def test(self, c: Condition, a: str, b: str) -> Column:
        left, right = quoted(a), quoted(b)
        if c.op == "==":
            # Where one side is never missing, plain equality says the same and keeps buckets usable.
            nullable = self.left.schema[a].nullable and self.right.schema[b].nullable if self.na == "na" else False
            return left.eqNullSafe(right) if nullable else left == right
        plain = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[c.op]
        return plain | (left.isNull() & right.isNull()) if self.na == "na" and c.op in (">=", "<=") else plain

    def condition(self) -> Column:
        return reduce(and_, (self.test(*k) for k in self.keys), F.lit(True))

    def unique_left(self) -> str:
        """A left column that tells rows apart: the row order, which is the same in every evaluation."""
        name = hidden("r")
        parts = [quoted(n).alias(f"k{i}") for i, (n, _) in enumerate(self.left_order)]
        self.left = self.left.withColumn(name, F.struct(*parts) if parts else F.monotonically_increasing_id())
        return name

    def nearest(self) -> None:
        """Replaces each closest condition by equality with the nearest right key.

        The keys of both sides are merged in one column, sorted once for each
        group of equal keys, and the last right key seen before a left row is
        its nearest.  With further inequalities the nearest is taken among the
        joined rows instead.
        """
        rolling = [k for k in self.keys if k[0].closest]
        if not rolling:
            return
        (c, a, b), others = rolling[0], [k for k in self.keys if not k[0].closest]
        if len(rolling) > 1 or any(k[0].op != "==" for k in others):
            self._nearest_among_joined(rolling)
            return
        equal = [(ka, kb) for _, ka, kb in others]
        down = c.op in ("<=", "<")
        strict = c.op in (">", "<")
        value, side, found = hidden(), hidden(), hidden("k")
        xs = self.left.withColumns({value: quoted(a), side: F.lit(0 if strict else 1), found: F.lit(None).cast(self.right.schema[b].dataType)})
        ys = self.right.select(*(quoted(kb).alias(ka) for ka, kb in equal), quoted(b)).where(quoted(b).isNotNull()).distinct()
        ys = ys.withColumns({value: quoted(b), side: F.lit(1 if strict else 0)}).withColumnRenamed(b, found)
        every = xs.unionByName(ys, allowMissingColumns=True)
        by = [F.desc_nulls_last(value) if down else F.asc_nulls_last(value), quoted(side)]
        so_far = (Window.unboundedPreceding, Window.currentRow)
        if equal:
            last = F.last(found, ignorenulls=True).over(Window.partitionBy(*(quoted(ka) for ka, _ in equal)).orderBy(*by).rowsBetween(*so_far))
        else:
            every, last = self._carried(every, value, found, by, down)
        near = every.withColumn(found, F.when(quoted(value).isNotNull(), last))
        self.left = near.where(quoted(side) == (0 if strict else 1)).select(*(quoted(n) for n in self.left.columns), quoted(found))
        # No nearest key must not match a missing one, unless both sides' keys are missing and may.
        both_missing = self.na == "na" and not strict
        self.keys = [*others, (Condition(c.x, "near", c.y), found, b)]
        plain = self.test

        def test(k: Condition, left: str, right: str) -> Column:
            if k.op != "near":
                return plain(k, left, right)
            same = quoted(left) == quoted(right)
            return same | (quoted(a).isNull() & quoted(right).isNull()) if both_missing else same

        self.test = test  # type: ignore[method-assign]

    def _carried(self, every: DataFrame, value: str, found: str, by: list[Column], down: bool) -> tuple[DataFrame, Column]:
        """The last key so far without sorting all rows in one task.

        The values are cut into ranges, each sorted on its own; a range without
        an earlier key takes the last one of the ranges before.
        """
        point = _number(every, value)
        limits, range_, carried, key = (hidden() for _ in range(4))
        shares = F.array(*(F.lit(k / _RANGES) for k in range(1, _RANGES)))
        every = every.crossJoin(F.broadcast(every.agg(F.percentile_approx(point, shares).alias(limits))))  # one row
        every = every.withColumn(range_, F.coalesce(F.size(F.filter(limits, lambda x: x <= point)), F.lit(-1))).drop(limits)
        ends = every.groupBy(F.col(range_).alias(key)).agg((F.min if down else F.max)(found).alias(carried))  # a row per range
        before = Window.partitionBy().orderBy(F.desc(key) if down else F.asc(key)).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn(carried, F.last(carried, ignorenulls=True).over(before))
        every = every.join(F.broadcast(ends), F.col(range_) == F.col(key)).drop(key)
        own = F.last(found, ignorenulls=True).over(Window.partitionBy(range_).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        name = hidden()
        every = every.withColumn(name, F.coalesce(own, F.col(carried))).drop(range_, carried)
        return every, quoted(name)

    def binned(self, width: float, how: str) -> None:
        """Adds an equality to a range join: both sides' ranges are cut into bins, which must be equal.

        A pair that shares several bins is kept in the first of them only.
        """
        low = [k for k in self.keys if k[0].op in (">=", ">") and not k[0].closest]
        high = [k for k in self.keys if k[0].op in ("<=", "<") and not k[0].closest]
        if len(low) != 1 or len(high) != 1:
            raise ValueError("bins need one lower and one upper limit")
        (_, xa, yb), (_, xc, yd) = low[0], high[0]
        point = low[0][0].x == high[0][0].x
        if how != "inner" and not (how == "left" and point):
            raise ValueError("bins serve inner joins, and left joins of a point with a range")

        def bins(df: DataFrame, a: str, b: str, outer: bool) -> tuple[DataFrame, str, str]:
            first, bin_ = hidden(), hidden("k")
            ends = [F.floor(_number(df, c) / F.lit(float(width))) for c in (a, b)]
            start, stop = F.least(*ends), F.greatest(*ends)
            explode = F.explode_outer if outer else F.explode
            whole = F.when(ends[0].isNotNull() & ends[1].isNotNull(), F.sequence(start, stop))
            return df.withColumn(first, start).withColumn(bin_, explode(whole)), first, bin_

        self.left, x_first, x_bin = bins(self.left, xc, xa, how == "left")
        self.right, y_first, y_bin = bins(self.right, yb, yd, False)
        plain = self.test

        def test(k: Condition, left: str, right: str) -> Column:
            if k.op != "bin":
                return plain(k, left, right)
            return (quoted(left) == quoted(right)) & (quoted(left) == F.greatest(quoted(x_first), quoted(y_first)))

        self.keys = [*self.keys, (Condition("", "bin", ""), x_bin, y_bin)]
        self.test = test  # type: ignore[method-assign]

    def _nearest_among_joined(self, rolling: list[tuple[Condition, str, str]]) -> None:
        row = self.unique_left()
        pairs = self.left.join(self.right, self.condition())
        for c, _, b in rolling:
            best = F.max(quoted(b)) if c.op in (">=", ">") else F.min(quoted(b))
            top = hidden()
            pairs = pairs.withColumn(top, best.over(Window.partitionBy(quoted(row)))).where(quoted(top).eqNullSafe(quoted(b)))
        right = [c for c in pairs.columns if c in self.right.columns]
        marker = hidden("k")
        self.right = pairs.select(*(quoted(c) for c in right), quoted(row).alias(marker))
        self.keys = [(Condition("", "==", ""), row, marker)]


def _number(df: DataFrame, name: str) -> Column:
    """A number for a range's end: itself, days, or seconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(quoted(name)).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return quoted(name).cast("timestamp").cast("double")
    return quoted(name).cast("double")


def _ordered(frame) -> tuple[DataFrame, Order]:
    frame = frame.with_order()
    return frame._df, frame.order


class JoinVerbs:
    def _other(self, y: Any, copy: bool):
        from ..frame import Frame

        if isinstance(y, Frame):
            return y
        if isinstance(y, DataFrame):
            return Frame(y)
        if isinstance(y, pd.DataFrame):
            if not copy:
                raise TypeError("a local table is joined with copy=True")
            from ..sources.tables import from_pandas

            return from_pandas(self.session, y)
        raise TypeError("the other table is a frame")

    def _mutating(self, y: Any, how: str, by: Any, copy: bool, suffix: tuple[str, str], keep: bool | None, na_matches: str, multiple: str, unmatched: Any, relationship: str | None, bin_width: float | None = None):
        y = self._other(y, copy)
        if multiple not in _MULTIPLE or relationship not in _RELATIONSHIPS or na_matches not in ("na", "never"):
            raise ValueError("no such multiple, relationship or na_matches")
        spec = as_join_spec(by, self.columns, y.columns)
        if spec.cross:
            warnings.warn("a join without columns is cross_join()", stacklevel=3)
            return self.cross_join(y, suffix=suffix)
        if keep is False and not spec.only_equal:
            raise ValueError("keep=False needs a join by equality only")
        self._check_columns(spec)
        s = _Sides(self, y, spec, na_matches)
        s.nearest()
        if bin_width is not None:
            s.binned(bin_width, how)
        if multiple != "all":
            self._single(s, multiple)
        self._contracts(s, how, unmatched, relationship, multiple)
        left_marker, right_marker = hidden(), hidden()
        left = s.left.withColumn(left_marker, F.lit(True))
        right = s.right.withColumn(right_marker, F.lit(True))
        joined = left.join(right, s.condition(), how)

        merged = {c.x: (c.x, s.names[c.y]) for c in spec.equal} if not keep else {}
        dropped = {c.y for c in spec.equal} if not keep else set()
        y_names = [c for c in y.columns if c not in dropped]
        x_names = self.columns
        new_x = [n if n in merged else None for n in x_names]
        rest = [n for n, k in zip(x_names, new_x) if k is None]
        renamed = dict(zip(rest, suffixed(rest, y_names, suffix[0], [n for n in x_names if n in merged])))
        new_y = dict(zip(y_names, suffixed(y_names, x_names, suffix[1])))
        out = []
        for n in x_names:
            if n in merged:
                a, b = merged[n]
                kind = common_key_type(self.schema[n].dataType, y.schema[next(c.y for c in spec.equal if c.x == n)].dataType)
                left_value, right_value = (quoted(v).cast(kind) if kind is not None else quoted(v) for v in (a, b))
                value = left_value if how in ("inner", "left") else F.when(quoted(left_marker).isNull(), right_value).otherwise(left_value)
                out.append(value.alias(n))
            else:
                out.append(quoted(n).alias(renamed[n]))
        out += [quoted(s.names[n]).alias(new_y[n]) for n in y_names]
        order = (*s.left_order, *s.right_order)
        kept = joined.select(*out, *(quoted(n) for n, _ in order))
        groups = [renamed.get(g, g) for g in self.groups]
        return self._with(kept, groups=groups, order=order)

    def _check_columns(self, spec: JoinSpec) -> None:
        for side in ("x", "y"):
            equal = [getattr(c, side) for c in spec.equal]
            other = {getattr(c, side) for c in spec.conditions if c.op != "=="}
            if len(set(equal)) < len(equal) or other & set(equal):
                raise ValueError("a join column is used twice")

    def _single(self, s: _Sides, multiple: str) -> None:
        """Keeps one match of each left row."""
        if all(c.op in ("==", "near") for c, _, _ in s.keys):
            keys = [quoted(b) for _, _, b in s.keys]
            spec = Window.partitionBy(*keys).orderBy(*(_reversed(s.right_order) if multiple == "last" else sort_columns(s.right_order)) or [F.lit(0)])
            number = hidden()
            s.right = s.right.withColumn(number, F.row_number().over(spec)).where(quoted(number) == 1).drop(number)
            return
        row, number, marker = s.unique_left(), hidden(), hidden("k")
        pairs = s.left.join(s.right, s.condition())
        spec = Window.partitionBy(quoted(row)).orderBy(*(_reversed(s.right_order) if multiple == "last" else sort_columns(s.right_order)) or [F.lit(0)])
        right = s.right.columns
        pairs = pairs.withColumn(number, F.row_number().over(spec)).where(quoted(number) == 1)
        s.right = pairs.select(*(quoted(c) for c in right), quoted(row).alias(marker))
        s.keys = [(Condition("", "==", ""), row, marker)]

    def _contracts(self, s: _Sides, how: str, unmatched: Any, relationship: str | None, multiple: str) -> None:
        """Raises if rows would be lost or match too often; asks for jobs only where a contract is given."""
        if isinstance(unmatched, str):
            unmatched = (unmatched, unmatched)
        if not set(unmatched) <= {"drop", "error"}:
            raise ValueError('unmatched is "drop" or "error"')
        if unmatched[0] == "error" and how in ("inner", "right") and not s.left.join(s.right, s.condition(), "left_anti").isEmpty():
            raise ValueError("a row of the left table has no match")
        if unmatched[1] == "error" and how in ("inner", "left") and not s.right.join(s.left, s.condition(), "left_anti").isEmpty():
            raise ValueError("a row of the right table has no match")
        if relationship in (None, "many-to-many"):
            return
        if relationship == "warn-many-to-many":
            if self._repeats(s, s.left, s.right) and self._repeats(s, s.right, s.left):
                warnings.warn("rows of both tables match several rows of the other: a many-to-many join", stacklevel=4)
            return
        for one, side in (("-to-one", "left"), ("one-to-", "right")):
            if one in relationship:
                a, b = (s.left, s.right) if side == "left" else (s.right, s.left)
                if self._repeats(s, a, b):
                    raise ValueError(f"a row of the {side} table matches several rows, against {relationship}")

    def _repeats(self, s: _Sides, a: DataFrame, b: DataFrame) -> bool:
        """Whether a row of a matches several rows of b: repeated keys of b that a has; pairs only where ranges are compared."""
        if all(c.op == "==" for c, _, _ in s.keys):
            own = [k for _, x, y in s.keys for k in (x, y) if k in b.columns]
            repeated = b.groupBy(*(quoted(k) for k in own)).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
            return not a.join(repeated, s.condition(), "left_semi").isEmpty()
        row = hidden("r")
        matches = a.withColumn(row, F.monotonically_increasing_id()).join(b, s.condition()).groupBy(row).count()
        return not matches.where("count > 1").isEmpty()

    def inner_join(self, y, by=None, copy=False, suffix=(".x", ".y"), keep=None, na_matches="na", multiple="all", unmatched="drop", relationship=None, bin_width=None):
        """Pairs of rows that match; bin_width cuts the ranges of a range join without equalities into bins.

        relationship="warn-many-to-many" asks for a warning if rows of both
        tables match several rows of the other, at the price of a job.
        """
        return self._mutating(y, "inner", by, copy, suffix, keep, na_matches, multiple, unmatched, relationship, bin_width)

    def left_join(self, y, by=None, copy=False, suffix=(".x", ".y"), keep=None, na_matches="na", multiple="all", unmatched="drop", relationship=None, bin_width=None):
        """All left rows, with their matches."""
        return self._mutating(y, "left", by, copy, suffix, keep, na_matches, multiple, unmatched, relationship, bin_width)

    def right_join(self, y, by=None, copy=False, suffix=(".x", ".y"), keep=None, na_matches="na", multiple="all", unmatched="drop", relationship=None):
        """All right rows, with their matches; those without come last."""
        return self._mutating(y, "right", by, copy, suffix, keep, na_matches, multiple, unmatched, relationship)

    def full_join(self, y, by=None, copy=False, suffix=(".x", ".y"), keep=None, na_matches="na", multiple="all", unmatched="drop", relationship=None):
        """All rows of both tables."""
        return self._mutating(y, "full", by, copy, suffix, keep, na_matches, multiple, unmatched, relationship)

    def _filtering(self, y: Any, how: str, by: Any, copy: bool, na_matches: str):
        y = self._other(y, copy)
        spec = as_join_spec(by, self.columns, y.columns)
        if spec.cross:
            empty = y._df.limit(1)
            return self._with(self._df.join(empty.select(F.lit(1)), F.lit(True), how))
        s = _Sides(self, y, spec, na_matches)
        s.nearest()
        return self._with(s.left.join(s.right, s.condition(), how), order=s.left_order)

    def semi_join(self, y, by=None, copy=False, na_matches="na"):
        """Left rows with a match."""
        return self._filtering(y, "left_semi", by, copy, na_matches)

    def anti_join(self, y, by=None, copy=False, na_matches="na"):
        """Left rows without a match."""
        return self._filtering(y, "left_anti", by, copy, na_matches)

    def nest_join(self, y, by=None, copy=False, keep=None, name="y", na_matches="na", unmatched="drop"):
        """Every left row with its matches as an array of structs, empty if there are none."""
        y = self._other(y, copy)
        spec = as_join_spec(by, self.columns, y.columns)
        s = _Sides(self, y, spec, na_matches)
        s.nearest()
        self._contracts(s, "left", ("drop", unmatched), None, "all")
        inner = [c for c in y.columns if keep or c not in {k.y for k in spec.equal}]
        place = F.struct(*(x.alias(f"k{i}") for i, x in enumerate(p for n, _ in s.right_order for p in (quoted(n).isNull(), quoted(n))))) if s.right_order else F.lit(0)
        item = F.struct(place.alias("place"), F.struct(*(quoted(s.names[c]).alias(c) for c in inner)).alias("row"))
        rows = F.transform(F.array_sort(F.collect_list(item)), lambda i: i["row"]).alias(name)
        if all(c.op in ("==", "near") for c, _, _ in s.keys):
            nested = s.right.groupBy(*(quoted(b) for _, _, b in s.keys)).agg(rows)
            joined = s.left.join(nested, s.condition(), "left")
        else:
            row = s.unique_left()
            key = hidden()
            pairs = s.left.select(quoted(row).alias(key), *(quoted(a) for _, a, _ in s.keys)).join(s.right, s.condition())
            nested = pairs.groupBy(quoted(key)).agg(rows)
            joined = s.left.join(nested, quoted(row) == quoted(key), "left")
        kind = joined.schema[name].dataType
        out = joined.withColumn(name, F.coalesce(quoted(name), F.array().cast(kind)))
        return self._with(out.select(*(quoted(c) for c in self.columns), quoted(name), *(quoted(n) for n, _ in s.left_order)), order=s.left_order)

    def cross_join(self, y, copy=False, suffix=(".x", ".y")):
        """Every left row with every right row; the size is the product, so one side should be small."""
        y = self._other(y, copy)
        s = _Sides(self, y, JoinSpec(()), "na")
        new_x = suffixed(self.columns, y.columns, suffix[0])
        new_y = suffixed(y.columns, self.columns, suffix[1])
        order = (*s.left_order, *s.right_order)
        joined = s.left.crossJoin(s.right)
        out = [quoted(c).alias(n) for c, n in zip(self.columns, new_x)] + [quoted(s.names[c]).alias(n) for c, n in zip(y.columns, new_y)]
        return self._with(joined.select(*out, *(quoted(n) for n, _ in order)), groups=[dict(zip(self.columns, new_x))[g] for g in self.groups], order=order)


def _reversed(order: Order) -> list[Column]:
    return [F.asc_nulls_first(quoted(n)) if down else F.desc_nulls_first(quoted(n)) for n, down in order]


def common_by(by: Any, x, y) -> dict[str, str]:
    """The columns that a join by equality would use."""
    return {c.x: c.y for c in as_join_spec(by, x.columns, y.columns).equal}

