import os

import duckdb
import pytest

from pricelake.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_sql(spark, tmp_path, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/got")
    got, want = duck.sql(f"select * from '{tmp_path}/got/*.parquet'"), duck.sql(ORACLES[name])
    assert dict(zip(got.columns, got.types, strict=True)) == dict(zip(want.columns, want.types, strict=True))
    columns = ",".join(f'"{c}"' for c in sorted(want.columns))
    assert sorted(map(str, got.select(columns).fetchall())) == sorted(map(str, want.select(columns).fetchall()))
