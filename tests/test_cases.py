"""What each case of a figure check says of itself, against the check and against the SQL that works it out of the texts."""

import duckdb
import pytest

from proofmark.jobs import field_queries
from proofmark.jobs.cases import ALCOHOL, VOLUMES, checked_sql
from proofmark.jobs.registry import ORACLE_SQL


@pytest.mark.parametrize(("name", "cases"), [("alcohol_cases", ALCOHOL), ("volume_cases", VOLUMES)])
def test_cases(spark, tmp_path, name, cases):
    spark.range(100).selectExpr("id as p_partkey", "cast(1 + id % 50 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(checked_sql(cases) + " order by p_partkey").fetchall()
    got = getattr(field_queries, name)(spark, str(tmp_path)).orderBy("p_partkey").collect()
    assert [tuple(r) for r in got] == want and len(want) == 100
    assert con.execute(f"select * from ({ORACLE_SQL[name]}) order by p_partkey").fetchall() == want
