"""Stories whose tables have gaps give what their SQL gives."""

import __spark_entry__ as entry
from tests import parity

SF = "/root/testdata/sf0.001"


def test_versions_of_stories_without_tasks_or_names(spark, tmp_path):
    """A customer without orders, one without a name, and one that is there twice."""
    for t in parity.TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "customer":
            df = df.unionByName(df.limit(3).selectExpr("c_custkey + 1000000 as c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
            df = df.selectExpr("c_custkey", "case when c_custkey % 7 > 0 then c_name end as c_name", "c_nationkey", "c_acctbal", "c_mktsegment").unionByName(df.filter("c_custkey = 8"))
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    con = parity.oracle(SF)
    for t in parity.TABLES:
        con.execute(f"create or replace view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert parity.differences(spark, con, entry.queries()["story_versions"], entry.oracle_sql()["story_versions"], str(tmp_path)) == []
