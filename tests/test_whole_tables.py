"""Queries whose batch is a whole table."""

from presswork.plans import relational

DATA = "/root/testdata/sf0.001"


def test_all_orders_are_split(spark):
    got = relational.known_new_split_all(spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert {r.outcome for r in got.collect()} == {"known", "new"}
