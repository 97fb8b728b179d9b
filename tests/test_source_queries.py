"""Queries that write source trees from tables, beside their SQL on small tables of odd shape."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


@pytest.fixture
def compared(spark, tmp_path):
    """Rows of a query over tables, and of its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        got = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want))

    return run


def test_customers_without_orders_have_no_framework(spark, compared):
    customers = spark.range(52).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"))
    orders = spark.range(26).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"))
    got, want = compared("source_frameworks", customer=customers, orders=orders)
    assert got == want and len(got) == 26
