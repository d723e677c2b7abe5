"""The queries that SQL can express against their SQL twins at sf0.01."""

import duckdb
import pytest

from jobtide.llm import queries
from tests.test_twins import TABLES, rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got, rel = rows(df.columns, df.collect()), db.sql(queries.ORACLE_SQL[name])
    assert got == rows(rel.columns, rel.fetchall())
