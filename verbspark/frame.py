"""The frame: a Spark DataFrame with groups, rowwise state and a row order."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .operators.columns import ColumnVerbs
from .operators.groups import GroupVerbs
from .operators.joins import JoinVerbs
from .operators.mutations import RowMutations
from .operators.rows import RowVerbs
from .operators.scoped import ScopedVerbs
from .operators.sets import SetVerbs
from .operators.summaries import SummaryVerbs
from .plans.expr import quoted
from .plans.lower import Context, Order, file_order, is_hidden, sort_columns
from .plans.select import resolve


class Frame(ColumnVerbs, RowVerbs, GroupVerbs, SummaryVerbs, JoinVerbs, SetVerbs, RowMutations, ScopedVerbs):
    """An immutable table; every verb returns a new one and nothing runs before an action.

    The row order is kept as hidden columns, that of files from the first time
    that it matters; Catalyst prunes what a plan does not need.  `df` is the
    plain DataFrame without them.
    """

    def __init__(self, df: DataFrame, groups: Iterable[str] = (), order: Order = (), rowwise: bool = False, drop: bool = True):
        self._df, self.groups, self.order, self.is_rowwise, self.drop = df, tuple(groups), tuple(order), rowwise, drop
        self._check_names()

    def _check_names(self) -> None:
        names = self.columns
        if len(set(names)) != len(names):
            raise ValueError("column names repeat: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
        if gone := [g for g in self.groups if g not in names]:
            raise KeyError(f"no such grouping columns: {', '.join(gone)}")

    # parts

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if not is_hidden(c)]

    @property
    def fields(self) -> list[T.StructField]:
        return [f for f in self._df.schema if not is_hidden(f.name)]

    @property
    def schema(self) -> T.StructType:
        return T.StructType(self.fields)

    @property
    def is_grouped(self) -> bool:
        return bool(self.groups) and not self.is_rowwise

    @property
    def df(self) -> DataFrame:
        """The visible columns, in no particular row order."""
        return self._df.select(*(quoted(c) for c in self.columns))

    @property
    def session(self):
        return self._df.sparkSession

    def __repr__(self) -> str:
        kind = "rowwise" if self.is_rowwise else f"groups: {', '.join(self.groups)}" if self.groups else "ungrouped"
        return f"Frame[{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in self.fields)}] ({kind})"

    # building new frames

    def _with(self, df: DataFrame, groups: Iterable[str] | None = None, order: Order | None = None, rowwise: bool | None = None, drop: bool | None = None) -> Frame:
        """A frame of the same kind; hidden columns that are not part of the order go."""
        order = self.order if order is None else tuple(order)
        keep = {n for n, _ in order}
        df = df.select(*(quoted(c) for c in df.columns if not is_hidden(c) or c in keep))
        groups = [g for g in self.groups if g in df.columns] if groups is None else list(groups)
        return Frame(df, groups, order, self.is_rowwise if rowwise is None else rowwise, self.drop if drop is None else drop)

    def _context(self, by: Iterable[str] | None = None) -> Context:
        return Context(self._df, list(self.groups if by is None else by) if not self.is_rowwise else [], self.order, self.is_rowwise)

    def _by(self, by: Any) -> list[str] | None:
        """The columns of a transient grouping; none of a grouped or rowwise frame."""
        if by is None:
            return None
        if self.groups or self.is_rowwise:
            raise ValueError("a transient grouping needs an ungrouped frame")
        return list(resolve(self.fields, [], by if isinstance(by, (list, tuple)) else [by]).values())

    def _names(self, *given: Any) -> list[str]:
        return list(resolve(self.fields, list(self.groups), given).values())

    # results

    def with_order(self) -> Frame:
        """The frame with its row order as hidden columns, if it has one."""
        if self.order:
            return self
        df, order = file_order(self._df)
        return self._with(df, order=order) if order else self

    def ordered(self) -> DataFrame:
        """The visible columns, sorted by the row order."""
        frame = self.with_order()
        df = frame._df.orderBy(*sort_columns(frame.order)) if frame.order else frame._df
        return df.select(*(quoted(c) for c in self.columns))

    def collect(self) -> list:
        return self.ordered().collect()

    def to_pandas(self):
        return self.ordered().toPandas()

    def tuples(self) -> list[tuple]:
        return [tuple(r) for r in self.collect()]

    def compute(self, name: str | None = None) -> Frame:
        """The frame, computed once: as a saved table, or persisted on the executors."""
        if name is None:
            return self._with(self._df.persist())
        self.df.write.mode("overwrite").saveAsTable(name)
        return Frame(self.session.table(name), self.groups, (), self.is_rowwise, self.drop)

    def collapse(self) -> Frame:
        return self

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def show_query(self) -> str:
        """The optimised logical plan."""
        return self.df._jdf.queryExecution().optimizedPlan().toString()

    def glimpse(self, rows: int = 10) -> str:
        """A transposed preview: a line per column with its type and first values."""
        head = self.ordered().limit(rows).collect()
        lines = [f"Columns: {len(self.columns)}"]
        lines += [f"$ {f.name} <{f.dataType.simpleString()}> {', '.join(str(r[f.name]) for r in head)}" for f in self.fields]
        return "\n".join(lines)

    def type_sum(self) -> dict[str, str]:
        """A short name of each column's type, levels and arrays included."""
        short = {"string": "chr", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "dbl", "float": "dbl", "boolean": "lgl", "date": "date", "timestamp": "dttm", "timestamp_ntz": "dttm", "binary": "raw"}
        kinds = {f.name: f.dataType for f in self.fields}
        named = {n: "list" if isinstance(k, (T.ArrayType, T.MapType)) else "tibble" if isinstance(k, T.StructType) else short.get(k.simpleString(), k.simpleString()) for n, k in kinds.items()}
        return {f.name: ("ord" if f.metadata.get("ordered") else "fct") if f.metadata.get("levels") else named[f.name] for f in self.fields}

    def dim_desc(self) -> str:
        return f"[{self._df.count():,} x {len(self.columns):,}]"

    def tbl_vars(self) -> list[str]:
        return self.columns

    def tbl_nongroup_vars(self) -> list[str]:
        return [c for c in self.columns if c not in self.groups]

    def tbl_ptype(self) -> DataFrame:
        return self.df.limit(0)

    def add_row(self, **values: Any) -> Frame:
        """The frame with a row appended; columns that are not given are null."""
        schema = T.StructType([f for f in self.fields if f.name in values])
        return self.bind_rows(Frame(self.session.createDataFrame([tuple(values[f.name] for f in schema)], schema)))


