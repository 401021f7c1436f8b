"""The part of the verbs that holds for unbounded input.

The table model has no streams, so this is an extension: selections, filters,
row-wise mutations, joins to static tables and windowed summaries run on a
streaming DataFrame; verbs that need all rows or their order raise.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame
from ..plans.expr import ROW
from ..plans.lower import Context, Summary
from ..plans.macros import expanded

_ALLOWED = frozenset({"select", "rename", "rename_with", "relocate", "inner_join", "left_join", "semi_join", "bind_rows", "union_all"})


class StreamFrame:
    """A frame whose data is a stream."""

    def __init__(self, df: DataFrame):
        if not df.isStreaming:
            raise ValueError("the data is no stream")
        self._frame = Frame(df)

    @property
    def df(self) -> DataFrame:
        return self._frame.df

    def _checked(self, given: tuple[Any, ...], named: dict[str, Any]) -> None:
        for name, e in expanded(self._frame.fields, [], given, named):
            if e is not None and any(x.kind != ROW for x in e.walk()):
                raise ValueError(f"{name} needs more than its own row, which a stream does not have")

    def filter(self, *conditions: Any) -> StreamFrame:
        self._checked(conditions, {})
        return StreamFrame(self._frame.filter(*conditions).df)

    def mutate(self, *given: Any, **named: Any) -> StreamFrame:
        self._checked(given, named)
        return StreamFrame(self._frame.mutate(*given, **named).df)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in _ALLOWED:
            raise AttributeError(f"{name}() needs all rows or their order, which a stream does not have")

        def verb(*given: Any, **named: Any) -> StreamFrame:
            given = tuple(g._frame if isinstance(g, StreamFrame) else g for g in given)
            return StreamFrame(getattr(self._frame, name)(*given, **named).df)

        return verb


def stream_from(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "parquet", **options: Any) -> StreamFrame:
    """A stream of the files that arrive in a folder."""
    return StreamFrame(spark.readStream.format(kind).schema(schema).options(**options).load(path))


def windowed(stream: StreamFrame, time: str, width: str, late: str, keys: tuple[str, ...] = (), slide: str | None = None, **aggregates: Any) -> DataFrame:
    """Summaries over tumbling or sliding windows of event time; rows later than `late` are dropped."""
    frame = stream._frame
    df = frame.df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    names = list(keys)
    summary = Summary(Context(df, [], ()), names)
    for name, e in expanded(frame.fields, names, [], aggregates):
        summary.add(name, e)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = df.groupBy(window.alias("window"), *names).agg(*(c.alias(n) for n, c in summary.aggregates.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *names, *(c.alias(n) for n, c in summary.results.items()))
