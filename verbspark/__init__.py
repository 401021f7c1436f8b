"""A grammar of data manipulation on Spark DataFrames."""

from . import functions
from .frame import Frame
from .operators.joins import common_by
from .operators.scoped import all_vars, any_vars, vars_
from .plans.expr import Expr, col, desc, lit
from .plans.joinspec import join_by
from .plans.macros import across, c_across, cur_column, if_all, if_any, pick
from .plans.select import all_of, any_of, contains, ends_with, everything, group_cols, is_character, is_logical, is_numeric, last_col, matches, num_range, one_of, span, starts_with, where

__all__ = [
    "Expr", "Frame", "across", "all_of", "all_vars", "any_of", "any_vars", "c_across", "col", "common_by", "contains", "cur_column", "desc", "ends_with", "everything", "functions", "group_cols", "if_all", "if_any",
    "is_character", "is_logical", "is_numeric", "join_by", "last_col", "lit", "matches", "num_range", "one_of", "pick", "span", "starts_with", "vars_", "where",
]
