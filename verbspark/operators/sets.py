"""Set operations and binding of tables."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expr import quoted
from ..plans.lower import Context, hidden, sort_columns
from .joins import common_key_type


def _aligned(frames: list, strict: bool = True) -> list[DataFrame]:
    """The frames' data with the first one's columns and common types; missing columns are null."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    if strict:
        for f in frames[1:]:
            if set(f.columns) != set(frames[0].columns):
                raise ValueError("the tables have different columns: " + ", ".join(sorted(set(f.columns) ^ set(frames[0].columns))))
    kinds: dict[str, T.DataType] = {}
    for f in frames:
        for field in f.fields:
            if field.name not in kinds:
                kinds[field.name] = field.dataType
            else:
                kinds[field.name] = common_key_type(kinds[field.name], field.dataType) or kinds[field.name]
    return [f._df.select(*((quoted(c) if c in f.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names)) for f in frames]


class SetVerbs:
    def union_all(self, y):
        """All rows of both tables."""
        self._check_same(y)
        return self._bound([self, y])

    def union(self, y):
        """Different rows of both tables."""
        return self.union_all(y).distinct()._like(self)

    def intersect(self, y):
        """Different rows that both tables have."""
        a, b = _aligned([self, y])
        return self._set(a.intersect(b))

    def setdiff(self, y):
        """Different rows that the other table lacks."""
        a, b = _aligned([self, y])
        return self._set(a.subtract(b))

    def symdiff(self, y):
        """Rows that exactly one of the tables has."""
        a, b = _aligned([self, y])
        return self._set(a.subtract(b).unionByName(b.subtract(a)))

    def setequal(self, y) -> bool:
        """Whether both tables have the same rows, order and repeats aside."""
        a, b = _aligned([self, y])
        return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()

    def all_equal(self, y) -> bool:
        """Whether both tables have the same rows as often, order aside."""
        a, b = _aligned([self, y])
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def _check_same(self, y) -> None:
        _aligned([self, y])

    def _like(self, x):
        return self._with(self._df, groups=x.groups, rowwise=x.is_rowwise, drop=x.drop)

    def _set(self, df: DataFrame):
        return self._with(df, groups=self.groups, order=())

    def _bound(self, frames: list, ids: list[Any] | None = None, id_name: str | None = None):
        """The tables one after another, each in its own order."""
        frames = [f.with_order() for f in frames]
        source = hidden("o")
        contexts = [Context(f._df, [], f.order) for f in frames]
        for context in contexts:
            if context.order:
                context.ascending()
        order = [hidden("o") for _ in range(max((len(c.order) for c in contexts), default=0))]
        parts = []
        for k, (f, df, context) in enumerate(zip(frames, _aligned(frames, strict=False), contexts)):
            kept = [quoted(n) for n, _ in context.order]
            columns = [c.cast(df.schema[n].dataType).alias(n) for n, c in ((n, quoted(n) if n in f.columns else F.lit(None)) for n in df.columns)]
            extra = [F.lit(ids[k]).alias(id_name)] if id_name else []
            places = [(kept[i] if i < len(kept) else F.lit(None)).alias(n) for i, n in enumerate(order)]
            parts.append((context.df.select(*extra, *columns, F.lit(k).alias(source), *places)))
        kinds = [[p.schema[n].dataType for p in parts] for n in order]
        for i, n in enumerate(order):
            real = {k.simpleString() for k in kinds[i] if not isinstance(k, T.NullType)}
            if len(real) > 1:  # orders of different kinds: each table's own row numbers
                parts = [p.withColumn(n, F.row_number().over(Window.partitionBy(source).orderBy(*sort_columns([(o, False) for o in order])))) for p in parts]
                parts = [p.drop(*(o for o in order if o != n)) for p in parts]
                order = [n]
                break
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return self._with(df, order=((source, False), *((n, False) for n in order)))

    def bind_rows(self, *others: Any, _id: str | None = None, _names: list[str] | None = None):
        """Tables one below another by column names; _id names a column with each row's table."""
        frames = [self, *(o for group in others for o in (group if isinstance(group, (list, tuple)) else [group]))]
        ids = list(_names) if _names else [str(k) for k in range(1, len(frames) + 1)]
        return self._bound(frames, ids, _id)

    def bind_cols(self, *others: Any):
        """Tables side by side by row number; sorts each as a whole, so for small tables."""
        from .joins import suffixed

        out = None
        counts = set()
        names: list[str] = []
        for k, f in enumerate([self, *others]):
            context = Context(f._df, [], f.order)
            context.row_order()
            place = "__place"
            df = context.df.withColumn(place, F.row_number().over(context.window()))
            counts.add(df.count())
            own = suffixed(f.columns, names, f"...{k + 1}")
            names += own
            df = df.select(place, *(quoted(c).alias(n) for c, n in zip(f.columns, own)))
            out = df if out is None else out.join(df, place)
        if len(counts) > 1:
            raise ValueError("the tables have different numbers of rows")
        order = hidden("o")
        return self._with(out.withColumnRenamed("__place", order), order=((order, False),))
