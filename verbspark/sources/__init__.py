"""Where frames come from and where they go."""

from .datasets import band_instruments, band_instruments2, band_members
from .tables import (
    as_frame, copy_to, create_table, data_type, from_pandas, from_rows, has_table, insert_into, is_tbl, lst, query_fields, query_rows, read, same_src, save_query, sql, src_tbls, tbl, tibble, tribble,
    write, write_table,
)

__all__ = [
    "as_frame", "band_instruments", "band_instruments2", "band_members", "copy_to", "create_table", "data_type", "from_pandas", "from_rows", "has_table", "insert_into", "is_tbl", "lst", "query_fields",
    "query_rows", "read", "same_src", "save_query", "sql", "src_tbls", "tbl", "tibble", "tribble", "write", "write_table",
]
