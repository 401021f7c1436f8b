"""Grouping and what can be asked about groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expr import quoted
from ..plans.lower import Context, hidden
from ..plans.select import resolve

#: Groups that a verb with a result per group on the driver accepts.
DRIVER_GROUPS = 10_000


class GroupVerbs:
    def group_by(self, *given: Any, _add: bool = False, _drop: bool | None = None, **named: Any):
        """Groups by columns or computed values; nothing is moved."""
        frame, names = self._computed(given, named)
        groups = list(dict.fromkeys([*(self.groups if _add else ()), *names]))
        return frame._with(frame._df, groups=groups, rowwise=False, drop=self.drop if _drop is None else _drop)

    def ungroup(self, *given: Any):
        """No groups, or without some of them."""
        if not given:
            return self._with(self._df, groups=(), rowwise=False)
        gone = set(self._names(*given))
        return self._with(self._df, groups=[g for g in self.groups if g not in gone], rowwise=False)

    def rowwise(self, *given: Any):
        """Every row a group; the given columns, or the groups, identify it."""
        if self.groups and not self.is_rowwise and given:
            raise ValueError("a grouped frame keeps its groups as identifiers")
        names = list(self.groups) if self.groups and not self.is_rowwise else list(resolve(self.fields, [], given).values())
        return self._with(self._df, groups=names, rowwise=True)

    def with_groups(self, groups: Any, function: Callable):
        """A function of the frame under other groups, then the frame's own groups again."""
        own = [groups] if isinstance(groups, str) else list(groups or ())
        out = function(self._with(self._df, groups=own, rowwise=False))
        return out._with(out._df, groups=[g for g in self.groups if g in out.columns], rowwise=self.is_rowwise)

    # metadata

    def group_vars(self) -> list[str]:
        return list(self.groups)

    def group_by_drop_default(self) -> bool:
        return self.drop

    def _keys(self) -> DataFrame:
        return self._df.select(*(quoted(g) for g in self.groups)).distinct()

    def group_keys(self):
        """A row per group, in ascending order of the keys."""
        from ..frame import Frame

        if not self.groups:
            return Frame(self.session.range(1).select())
        df = self._keys()
        names = [hidden("o") for _ in self.groups]
        return Frame(df.withColumns({n: quoted(g) for n, g in zip(names, self.groups)}), order=[(n, False) for n in names])

    def n_groups(self) -> int:
        return self._keys().count() if self.groups else 1

    def group_size(self) -> list[int]:
        """The sizes of the groups, in the order of their keys; for few groups."""
        found = self._sizes().limit(DRIVER_GROUPS + 1).collect()
        if len(found) > DRIVER_GROUPS:
            raise ValueError(f"more than {DRIVER_GROUPS} groups; use tally()")
        return [r.n for r in found]

    def _sizes(self) -> DataFrame:
        if not self.groups:
            return self._df.agg(F.count(F.lit(1)).alias("n"))
        keys = [quoted(g) for g in self.groups]
        return self._df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*(F.asc_nulls_last(k) for k in keys))

    def group_indices(self):
        """The frame with its rows' group numbers, from 1, as column .group."""
        from ..functions.windows import cur_group_id

        return self.mutate(**{".group": cur_group_id()})

    def _with_places(self) -> tuple[DataFrame, str]:
        context = Context(self._df, [], self.order)
        context.row_order()
        name = hidden()
        return context.df.withColumn(name, F.row_number().over(context.window())), name

    def group_data(self):
        """A row per group with its row numbers as column .rows."""
        from ..frame import Frame

        df, place = self._with_places()
        rows = F.array_sort(F.collect_list(place)).alias(".rows")
        if not self.groups:
            return Frame(df.agg(rows))
        keys = [quoted(g) for g in self.groups]
        names = [hidden("o") for _ in keys]
        return Frame(df.groupBy(*keys).agg(rows).withColumns(dict(zip(names, keys))), order=[(n, False) for n in names])

    def group_rows(self) -> list[list[int]]:
        """The row numbers of each group; for few groups."""
        if self.groups and self._keys().limit(DRIVER_GROUPS + 1).count() > DRIVER_GROUPS:
            raise ValueError(f"more than {DRIVER_GROUPS} groups; use group_data()")
        return self.group_data().pull(".rows")

    def factor(self, column: str, levels: list[str] | None = None, ordered: bool = False):
        """Gives a text column levels, in ascending order of its values by default; values without a level become missing.

        Levels order the rows of arrange() and groups, and stand for empty groups.
        """
        if levels is None:
            found = self._df.select(quoted(column)).where(quoted(column).isNotNull()).distinct().limit(DRIVER_GROUPS + 1).collect()
            if len(found) > DRIVER_GROUPS:
                raise ValueError(f"more than {DRIVER_GROUPS} levels")
            levels = sorted(r[0] for r in found)
        known = self._df.withColumn(column, F.when(quoted(column).isin(levels), quoted(column)))
        return self._with(known.withMetadata(column, {"levels": list(levels), "ordered": ordered}))

    def recode_factor(self, column: str, mapping: dict[str, str], default: str | None = None):
        """New texts for a column's values, its levels in the order of the mapping."""
        from ..functions.conditionals import recode

        rest = [] if default is not None else [v for v in self._df.schema[column].metadata.get("levels", []) if v not in mapping]
        out = self.mutate(**{column: recode(column, mapping, default)})
        return out.factor(column, list(dict.fromkeys([*mapping.values(), *rest, *([default] if default is not None else [])])))

    def group_trim(self):
        """Without factor levels that no row has."""
        df = self._df
        for g in self.groups:
            field = df.schema[g]
            if levels := field.metadata.get("levels"):
                present = {r[0] for r in df.select(quoted(g)).distinct().limit(len(levels) + 1).collect()}
                df = df.withMetadata(g, {**field.metadata, "levels": [v for v in levels if v in present]})
        return self._with(df)

    # nesting

    def _nested(self, key: str, keep: bool):
        from ..frame import Frame

        context = Context(self._df, [], self.order)
        inner = [c for c in self.columns if keep or c not in self.groups]
        item = F.struct(context.position().alias("__place"), F.struct(*(quoted(c) for c in inner)).alias("row"))
        rows = F.transform(F.array_sort(F.collect_list(item)), lambda s: s["row"]).alias(key)
        if not self.groups:
            return Frame(context.df.agg(rows))
        keys = [quoted(g) for g in self.groups]
        names = [hidden("o") for _ in keys]
        return Frame(context.df.groupBy(*keys).agg(rows).withColumns(dict(zip(names, keys))), order=[(n, False) for n in names])

    def group_nest(self, *given: Any, _key: str = "data", _keep: bool = False):
        """A row per group with its rows as an array of structs."""
        frame = self.group_by(*given) if given else self
        return frame._nested(_key, _keep)

    def nest_by(self, *given: Any, _key: str = "data", _keep: bool = False):
        """As group_nest(), each row then a group of its own."""
        frame = self.group_by(*given) if given else self
        out = frame._nested(_key, _keep)
        return out._with(out._df, groups=frame.groups, rowwise=True)

    def unnest(self, column: str):
        """Rows of an array of structs as rows of the frame; empty arrays give none."""
        rest = [quoted(c) for c in self._df.columns if c != column]
        inner = [f.name for f in self._df.schema[column].dataType.elementType]
        place, item = hidden("o"), hidden()
        df = self._df.select(*rest, F.posexplode(quoted(column)).alias(place, item))
        df = df.select(*rest, quoted(place), *(quoted(item)[n].alias(n) for n in inner))
        return self._with(df, order=(*self.order, (place, False)))

    # any function per group

    def _each_key(self) -> list:
        rows = self.group_keys().ordered().limit(DRIVER_GROUPS + 1).collect() if self.groups else [()]
        if len(rows) > DRIVER_GROUPS:
            raise ValueError(f"more than {DRIVER_GROUPS} groups; use group_modify()")
        return rows

    def group_split(self, *given: Any, _keep: bool = True) -> list:
        """A list of frames, one per group; for few groups."""
        frame = self.group_by(*given) if given else self
        out = []
        for key in frame._each_key():
            match = reduce(and_, (quoted(g).eqNullSafe(F.lit(v)) for g, v in zip(frame.groups, key)), F.lit(True))
            part = frame._with(frame._df.where(match), groups=(), rowwise=False)
            out.append(part if _keep else part.select(*(c for c in part.columns if c not in frame.groups)))
        return out

    def group_map(self, function: Callable, _keep: bool = False) -> list:
        """function(frame, key) of each group, in a list; for few groups."""
        parts = self.group_split(_keep=_keep) if self.groups else [self]
        return [function(part, key) for part, key in zip(parts, self._each_key())]

    def group_walk(self, function: Callable, _keep: bool = False):
        """As group_map() for its effects; returns the frame."""
        self.group_map(function, _keep)
        return self

    def group_modify(self, function: Callable[[pd.DataFrame, tuple], pd.DataFrame], schema: str | T.StructType, _keep: bool = False):
        """function(rows, key) of each group as pandas frames, on the executors; a group must fit a task."""
        from ..frame import Frame

        groups = list(self.groups)
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if clash := [f.name for f in kind if f.name in groups]:
            raise ValueError(f"the result must not hold grouping columns: {', '.join(clash)}")
        whole = T.StructType([*(self._df.schema[g] for g in groups), *kind])
        inner = [c for c in self.columns if _keep or c not in groups]
        context = Context(self._df, [], self.order)
        place, position = hidden(), context.position()
        df = context.df.withColumn(place, position).select(*dict.fromkeys([*groups, *inner]), place)

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            order = rows[place].map(lambda d: tuple(d.values()) if isinstance(d, dict) else tuple(d))
            rows = rows.loc[order.sort_values(kind="stable").index]
            out = function(rows[inner].reset_index(drop=True), key)
            for i, g in enumerate(groups):
                out.insert(i, g, [key[i]] * len(out))
            return out[[f.name for f in whole]]

        if not groups:
            return Frame(df.groupBy(F.lit(0)).applyInPandas(lambda rows: run((), rows), whole))
        names = [hidden("o") for _ in groups]
        out = df.groupBy(*(quoted(g) for g in groups)).applyInPandas(run, whole).withColumns({n: quoted(g) for n, g in zip(names, groups)})
        return Frame(out, groups, [(n, False) for n in names])

    do = group_modify


