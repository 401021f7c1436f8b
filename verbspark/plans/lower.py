"""How expressions become Spark columns in a row, a window or an aggregate."""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import AGG, ROW, WIN, Col, Desc, Expr, quoted

_numbers = count()


def hidden(kind: str = "t") -> str:
    """A fresh name for a column that users do not see."""
    return f"__{kind}{next(_numbers)}"


def is_hidden(name: str) -> bool:
    return name.startswith("__") and name[3:].isdigit()


Order = tuple[tuple[str, bool], ...]  # hidden column and whether it descends


def file_order(df: DataFrame) -> tuple[DataFrame, Order]:
    """The data with its files' row order as hidden columns, where files still show through it.

    Only asked for when an order is needed, so that other plans do not number
    the rows of their scans.
    """
    file, row = hidden("o"), hidden("o")
    try:
        found = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
        found.schema  # analysed here
    except AnalysisException:
        return df, ()
    return found, ((file, False), (row, False))


def level_key(schema: T.StructType, name: str) -> Column:
    """What a column sorts by: the places of its values among its levels, if it has levels."""
    levels = schema[name].metadata.get("levels") if name in schema.names else None
    if not levels:
        return quoted(name)
    place = F.array_position(F.array(*map(F.lit, levels)), quoted(name))
    return F.when(place > 0, place)


def sort_columns(order: Order) -> list[Column]:
    return [F.desc_nulls_last(quoted(n)) if down else F.asc_nulls_last(quoted(n)) for n, down in order]


def descending(kind: T.DataType, column: Column) -> Column | None:
    """A value that ascends where the column descends; None for types that have none."""
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(column)
    if isinstance(kind, T.BooleanType):
        return ~column
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return -column
    if isinstance(kind, T.DecimalType):
        return -column
    if isinstance(kind, T.DateType):
        return F.bitwise_not(F.unix_date(column))
    if isinstance(kind, T.TimestampType):
        return F.bitwise_not(F.unix_micros(column))
    if isinstance(kind, T.TimestampNTZType):
        minutes = F.unix_date(column.cast("date")).cast("long") * 1440 + F.hour(column) * 60 + F.minute(column)
        return F.bitwise_not(minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long"))
    if isinstance(kind, T.BinaryType) or kind == T.StringType():  # not texts in another collation
        # Complements of the bytes; the end mark comes after them, so that a text precedes its own beginnings.
        return F.concat(F.translate(F.hex(column), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return None


class Context:
    """The frame that expressions are built for: its data, groups and row order.

    Building may add hidden columns to `df`, for windows inside windows and for
    aggregates over a whole table, so the frame to go on with is `df` afterwards.
    """

    def __init__(self, df: DataFrame, groups: list[str], order: Order, rowwise: bool = False):
        self.df, self.groups, self.order, self.rowwise = df, groups, order, rowwise
        self.over = lambda a: a  # how an aggregate function is applied

    # what builders ask for

    def type_of(self, column: Column) -> T.DataType:
        return self.df.select(column.alias("x")).schema[0].dataType

    def check_comparable(self, label: str, a: Column, b: Column) -> None:
        try:
            kinds = [self.type_of(x) for x in (a, b)]
        except AnalysisException:  # built from aggregates, which the frame does not have
            return
        text = [isinstance(k, T.StringType) for k in kinds]
        number = [isinstance(k, (T.NumericType, T.BooleanType)) for k in kinds]
        if any(text) and any(number):
            raise TypeError(f"{label} compares {kinds[0].simpleString()} with {kinds[1].simpleString()}")

    def is_float(self, column: Column) -> bool:
        return isinstance(self.type_of(column), (T.DoubleType, T.FloatType))

    def missing(self, column: Column) -> Column:
        return column.isNull() | F.isnan(column) if self.is_float(column) else column.isNull()

    def without_nan(self, column: Column) -> Column:
        """NaN as null, for floating columns only."""
        return F.when(~F.isnan(column), column) if self.is_float(column) else column

    def window(self, by: list[Column] | None = None, within: list[Column] | None = None, ties: bool = False) -> WindowSpec:
        """A window over the groups and `within`, ordered by `by` and, unless ties are wanted, by row order."""
        spec = Window.partitionBy(*(quoted(g) for g in self.groups), *(within or []))
        return spec.orderBy(*(by or []), *([] if ties else self.row_order()))

    def known_order(self) -> None:
        """Keeps the files' row order, before it can no longer be asked for."""
        if not self.order:
            self.df, self.order = file_order(self.df)

    def row_order(self) -> list[Column]:
        self.known_order()
        if not self.order:
            name = hidden("o")
            self.df = self.df.withColumn(name, F.monotonically_increasing_id())
            self.order = ((name, False),)
        return sort_columns(self.order)

    def ascending(self) -> None:
        """Makes all columns of the row order ascend."""
        self.row_order()
        if not any(down for _, down in self.order):
            return
        turned = {n: descending(self.df.schema[n].dataType, quoted(n)) for n, down in self.order if down}
        if any(v is None for v in turned.values()):  # arrays, structs and collated texts: the rows are numbered in one task
            name = hidden("o")
            self.df = self.df.withColumn(name, F.row_number().over(Window.partitionBy().orderBy(*self.row_order())))
            self.order = ((name, False),)
            return
        names = {n: hidden("o") for n in turned}
        self.df = self.df.withColumns({names[n]: v for n, v in turned.items()})
        self.order = tuple((names.get(n, n), False) for n, _ in self.order)

    def position(self) -> Column:
        """A value that ascends with the row order."""
        self.ascending()
        # A missing sort key comes last, so its absence is the first thing to compare.
        parts = [x for n, _ in self.order for x in (quoted(n).isNull(), quoted(n))]
        return F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts)))

    # building

    def build(self, expr: Expr) -> Column:
        """A column for a row of the frame; aggregates stand for their group's value in every row."""
        return self._window(expr)[0]

    def _window(self, expr: Expr) -> tuple[Column, bool]:
        built = [self._window(c) for c in expr.children]
        columns, nested = [c for c, _ in built], any(w for _, w in built)
        if expr.kind == ROW:
            return expr.build(self, *columns), nested
        if expr.kind == AGG and self.rowwise:
            return expr.scalar(self, *columns), nested
        if expr.kind == AGG and self.groups and expr.as_window is not None:
            return self._window(expr.as_window)
        columns = [self.settled(c) if w else c for c, w in built]
        if expr.kind == WIN:
            return expr.build(self, *columns), True
        if self.groups:
            spec = Window.partitionBy(*(quoted(g) for g in self.groups))
            self.over = lambda a: a.over(spec)
            out = expr.build(self, *columns)
            self.over = lambda a: a
            return out, True
        name = hidden()
        self.known_order()
        value = expr.build(self, *columns)
        self.df = self.df.crossJoin(F.broadcast(self.df.agg(value.alias(name))))  # one row
        return quoted(name), False

    def settled(self, column: Column) -> Column:
        """The column as a hidden column of the frame."""
        name = hidden()
        self.df = self.df.withColumn(name, column)
        return quoted(name)

    def looked_up(self, table: DataFrame, name: str) -> Column:
        """A value of a table with a row per group, as a hidden column."""
        self.known_order()
        out = hidden()
        keys = {g: hidden("k") for g in self.groups}
        side = table.select(*(quoted(g).alias(k) for g, k in keys.items()), quoted(name).alias(out))
        match = reduce(and_, (quoted(g).eqNullSafe(quoted(k)) for g, k in keys.items()))
        self.df = self.df.join(side, match, "left").drop(*keys.values())
        return quoted(out)

    def sort_key(self, expr: Expr) -> tuple[Column, bool]:
        down = isinstance(expr, Desc)
        key = expr.children[0] if down else expr
        if isinstance(key, Col) and key.name in self.df.columns and self.df.schema[key.name].metadata.get("levels"):
            return level_key(self.df.schema, key.name), down
        return self.without_nan(self.build(key)), down


class Summary:
    """Builds the expressions of a summary: aggregates first, then what is computed from them.

    A later expression sees earlier results, which are single values for it.
    """

    def __init__(self, context: Context, keys: list[str]):
        self.context, self.keys = context, keys
        self.aggregates: dict[str, Column] = {}
        self.results: dict[str, Column] = {}

    def add(self, name: str, expr: Expr) -> None:
        column = self._after(expr)
        self.results.pop(name, None)  # a repeated name moves to the end
        self.results[name] = column

    def _single(self, expr: Expr) -> bool:
        """Whether an expression is one value per group without aggregating."""
        if isinstance(expr, Col):
            return expr.name in self.results or expr.name in self.keys
        return expr.kind == ROW and all(self._single(c) for c in expr.children)

    def _after(self, expr: Expr) -> Column:
        if isinstance(expr, Col):
            if expr.name in self.results:
                return self.results[expr.name]
            if expr.name in self.keys:
                return quoted(expr.name)
            raise ValueError(f"`{expr.name}` has a value per row; a summary needs one per group (reframe() takes any number)")
        if expr.kind == ROW:
            return expr.build(self.context, *(self._after(c) for c in expr.children))
        if expr.kind == WIN:
            raise ValueError(f"{expr.label}() has a value per row; a summary needs one per group")
        if expr.children and all(self._single(c) for c in expr.children) and any(n in self.results for n in expr.names()):
            return expr.scalar(self.context, *(self._after(c) for c in expr.children))
        columns = []
        for child in expr.children:
            column, windowed = self.context._window(child)
            columns.append(self.context.settled(column) if windowed else column)
        name = hidden()
        self.aggregates[name] = expr.build(self.context, *columns)
        return quoted(name)

    def frame(self, extra: dict[str, Column] | None = None) -> DataFrame:
        wanted = [c.alias(n) for n, c in {**self.aggregates, **(extra or {})}.items()] or [F.count(F.lit(1)).alias(hidden())]
        grouped = self.context.df.groupBy(*(quoted(k) for k in self.keys)) if self.keys else self.context.df
        return grouped.agg(*wanted)
