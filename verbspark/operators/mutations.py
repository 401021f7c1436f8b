"""Verbs that insert, change and delete rows by key."""

from __future__ import annotations

import warnings
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.expr import quoted
from ..plans.lower import hidden


class RowMutations:
    def _by_columns(self, y, by: Any) -> list[str]:
        if by is None:
            by = [y.columns[0]]
            warnings.warn(f"rows are matched by {by[0]}", stacklevel=4)
        keys = [by] if isinstance(by, str) else list(by)
        for side, frame in (("the table", self), ("the other table", y)):
            if gone := [k for k in keys if k not in frame.columns]:
                raise KeyError(f"{side} has no column {', '.join(gone)}")
        return keys

    def _fitted(self, y, keys: list[str], only_keys: bool = False) -> DataFrame:
        """y's columns in x's types, under hidden names."""
        if not only_keys and (extra := [c for c in y.columns if c not in self.columns]):
            raise ValueError(f"columns that the table lacks: {', '.join(extra)}")
        wanted = keys if only_keys else y.columns
        return y._df.select(*(quoted(c).cast(self._df.schema[c].dataType).alias(c) for c in wanted))

    def _match(self, right: dict[str, str], keys: list[str]) -> Column:
        return reduce(and_, (quoted(k).eqNullSafe(quoted(right[k])) for k in keys))

    def _renamed_side(self, df: DataFrame, keys: list[str]) -> tuple[DataFrame, dict[str, str]]:
        names = {c: hidden() for c in df.columns}
        return df.select(*(quoted(c).alias(n) for c, n in names.items())), names

    def _check_unique(self, df: DataFrame, keys: list[str]) -> None:
        if not df.groupBy(*(quoted(k) for k in keys)).count().where("count > 1").isEmpty():
            raise ValueError("keys of the other table repeat")

    def _policy(self, value: str, what: str) -> None:
        if value not in ("error", "ignore"):
            raise ValueError(f'{what} is "error" or "ignore"')

    def _appended(self, df: DataFrame, y):
        from ..frame import Frame

        return self.bind_rows(Frame(df, order=()))

    def rows_insert(self, y, by: Any = None, conflict: str = "error"):
        """Adds rows with new keys; existing keys are an error or left out."""
        self._policy(conflict, "conflict")
        keys = self._by_columns(y, by)
        fitted = self._fitted(y, keys)
        side, names = self._renamed_side(self._df.select(*(quoted(k) for k in keys)), keys)
        match = self._match(names, keys)
        if conflict == "error" and not fitted.join(side, match, "left_semi").isEmpty():
            raise ValueError("keys exist already")
        return self._appended(fitted.join(side, match, "left_anti") if conflict == "ignore" else fitted, y)

    def rows_append(self, y):
        """Adds rows, whatever their keys."""
        return self._appended(self._fitted(y, []), y)

    def _changed(self, y, by: Any, unmatched: str | None, value) -> tuple[Any, DataFrame, list[str]]:
        keys = self._by_columns(y, by)
        fitted = self._fitted(y, keys)
        self._check_unique(fitted, keys)
        if unmatched is not None:
            self._check_matched(fitted, keys, unmatched)
        side, names = self._renamed_side(fitted, keys)
        found = hidden()
        frame = self.with_order()
        joined = frame._df.join(side.withColumn(found, F.lit(True)), self._match(names, keys), "left")
        columns = [value(quoted(c), quoted(names[c]), quoted(found)).alias(c) if c in names and c not in keys else quoted(c) for c in frame._df.columns]
        return frame._with(joined.select(*columns)), fitted, keys

    def _check_matched(self, fitted: DataFrame, keys: list[str], unmatched: str) -> None:
        self._policy(unmatched, "unmatched")
        side, names = self._renamed_side(self._df.select(*(quoted(k) for k in keys)), keys)
        if unmatched == "error" and not fitted.join(side, self._match(names, keys), "left_anti").isEmpty():
            raise ValueError("keys do not exist")

    def rows_update(self, y, by: Any = None, unmatched: str = "error"):
        """Overwrites values of existing keys, also with missing ones."""
        return self._changed(y, by, unmatched, lambda old, new, found: F.when(found, new).otherwise(old))[0]

    def rows_patch(self, y, by: Any = None, unmatched: str = "error"):
        """Fills in missing values of existing keys."""
        return self._changed(y, by, unmatched, lambda old, new, found: F.coalesce(old, new))[0]

    def rows_upsert(self, y, by: Any = None):
        """Overwrites values of existing keys and adds the other rows."""
        updated, fitted, keys = self._changed(y, by, None, lambda old, new, found: F.when(found, new).otherwise(old))
        side, names = self._renamed_side(self._df.select(*(quoted(k) for k in keys)), keys)
        return updated._appended(fitted.join(side, self._match(names, keys), "left_anti"), y)

    def rows_delete(self, y, by: Any = None, unmatched: str = "error"):
        """Removes rows by key; other columns of y do not count."""
        keys = self._by_columns(y, by)
        fitted = self._fitted(y, keys, only_keys=True)
        self._check_matched(fitted, keys, unmatched)
        side, names = self._renamed_side(fitted, keys)
        frame = self.with_order()
        return frame._with(frame._df.join(side, self._match(names, keys), "left_anti"))
