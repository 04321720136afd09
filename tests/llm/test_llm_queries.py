"""The registered queries against their SQL, on the smallest scale."""

import duckdb
import pytest

from auxoline.llm.queries import ORACLES, QUERIES
from check import TABLES, rows_of


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    got = rows_of([tuple(r) for r in df.select(cols).collect()], cols)
    assert got == rows_of(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall(), cols)
