"""Frames from tables, files and local data, and the catalog's view of them."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..frame import Frame
from ..plans.lower import hidden


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | T.StructType | None = None, **options: Any) -> Frame:
    """A frame of files: parquet, orc, csv, json, text or any other source of Spark.

    The row order of Parquet files is known, and taken when a verb needs it.
    """
    reader = spark.read.format(kind).options(**options)
    return Frame((reader.schema(schema) if schema is not None else reader).load(path))


class sql(str):  # noqa: N801
    """The text of a whole query, where a table's name is asked for."""


def tbl(source: Any, name: str | None = None, **options: Any) -> Frame:
    """A table of a session's catalog or of a JDBC address, the rows of a query given as sql(), or a DataFrame."""
    if isinstance(source, Frame):
        return source
    if isinstance(source, DataFrame):
        return Frame(source)
    if isinstance(source, SparkSession):
        if "url" in options:
            return Frame(source.read.format("jdbc").option("query" if isinstance(name, sql) else "dbtable", name).options(**options).load())
        if isinstance(name, sql):
            return Frame(source.sql(name))
        return Frame(source.table(name))
    raise TypeError("a table comes from a session or a DataFrame")


def is_tbl(x: Any) -> bool:
    return isinstance(x, Frame)


def as_frame(df: DataFrame) -> Frame:
    return Frame(df)


def from_pandas(spark: SparkSession, data: pd.DataFrame, schema: str | T.StructType | None = None) -> Frame:
    """A frame of local data, in its order."""
    return from_rows(spark, list(data.astype(object).where(data.notna(), None).itertuples(index=False, name=None)), schema or ", ".join(f"`{c}` {_kind(t)}" for c, t in data.dtypes.items()))


def _kind(dtype: Any) -> str:
    text = str(dtype)
    for start, kind in (("int32", "int"), ("int", "long"), ("float", "double"), ("bool", "boolean"), ("datetime", "timestamp")):
        if text.startswith(start):
            return kind
    return "string"


def from_rows(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> Frame:
    """A frame of literal rows, in their order."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    place = hidden("o")
    whole = T.StructType([*kind, T.StructField(place, T.LongType())])
    return Frame(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], whole), order=((place, False),))


def lst(**values: Any) -> dict[str, Any]:
    """Named values in order; a function is called with the values before it."""
    out: dict[str, Any] = {}
    for name, value in values.items():
        out[name] = value(out) if callable(value) else value
    return out


def tibble(spark: SparkSession, schema: str, **columns: list) -> Frame:
    """A frame from columns; one of length 1 repeats."""
    n = max((len(c) for c in columns.values()), default=0)
    filled = [c * n if len(c) == 1 else c for c in columns.values()]
    if any(len(c) != n for c in filled):
        raise ValueError("the columns have different lengths")
    return from_rows(spark, list(zip(*filled)), schema)


def tribble(spark: SparkSession, schema: str, *cells: Any) -> Frame:
    """A frame from cells, row by row."""
    width = len(T.StructType.fromDDL(schema))
    if len(cells) % width:
        raise ValueError("the cells do not fill the rows")
    return from_rows(spark, [tuple(cells[k : k + width]) for k in range(0, len(cells), width)], schema)


def copy_to(spark: SparkSession, data: Any, name: str, overwrite: bool = False) -> Frame:
    """Local data or a frame as a named view of the session."""
    if not overwrite and spark.catalog.tableExists(name):
        raise ValueError(f"there is a table {name}")
    frame = from_pandas(spark, data) if isinstance(data, pd.DataFrame) else data if isinstance(data, Frame) else Frame(data)
    frame.df.createOrReplaceTempView(name)
    return frame


def src_tbls(spark: SparkSession) -> list[str]:
    """The names of the session's tables and views."""
    return [t.name for t in spark.catalog.listTables()]


def same_src(x: Frame, y: Frame) -> bool:
    return x.session is y.session


def write(frame: Frame, path: str, kind: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options: Any) -> None:
    """Writes the visible columns; rows are not sorted."""
    writer = frame.df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_table(frame: Frame, name: str, mode: str = "error", bucket_by: tuple[int, str] | None = None) -> None:
    """Saves a table, in buckets of a column for joins without a shuffle.

    Buckets serve joins with na_matches="never", since keys that may be missing
    on both sides are compared by more than their values.
    """
    writer = frame.df.write.mode(mode)
    (writer.bucketBy(*bucket_by).sortBy(bucket_by[1]) if bucket_by else writer).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def _source(spark: SparkSession, what: str) -> DataFrame:
    return spark.sql(what) if isinstance(what, sql) else spark.table(what)


def query_fields(spark: SparkSession, what: str) -> list[str]:
    """The columns of a table or of a query given as sql(); nothing runs."""
    return _source(spark, what).columns


def query_rows(spark: SparkSession, what: str) -> int:
    """The number of rows of a table or of a query given as sql()."""
    return _source(spark, what).count()


def data_type(frame: Frame) -> dict[str, str]:
    """The SQL type of each column."""
    return {f.name: f.dataType.simpleString() for f in frame.fields}


def create_table(spark: SparkSession, name: str, schema: str | T.StructType) -> Frame:
    """An empty saved table."""
    spark.createDataFrame([], schema).write.saveAsTable(name)
    return tbl(spark, name)


def insert_into(frame: Frame, name: str) -> None:
    """Appends a frame's rows to a saved table, columns by name."""
    frame.df.select(*frame.session.table(name).columns).write.insertInto(name)


def save_query(spark: SparkSession, query: str, name: str) -> Frame:
    """A query's text as a named view of the session."""
    _source(spark, sql(query)).createOrReplaceTempView(name)
    return tbl(spark, name)


def analyze(spark: SparkSession, name: str) -> None:
    """Collects a saved table's statistics for the optimiser."""
    spark.sql(f"ANALYZE TABLE `{name}` COMPUTE STATISTICS FOR ALL COLUMNS")
