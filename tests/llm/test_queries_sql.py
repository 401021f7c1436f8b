"""Registered queries against their SQL."""

import pytest

from verbspark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op5_secret_ledger", "op6_decontamination"])
def test_query_against_sql(same_rows, name):
    same_rows(name, QUERIES, ORACLE_SQL)
