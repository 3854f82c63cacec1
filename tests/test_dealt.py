"""Documents that are compared by key: how many a task gets does not grow with the table."""

import pytest
from pyspark.sql import functions as F

from veilwork.plans.queries import QUERIES
from veilwork.session import TASK_ROWS, dealt


def test_rows_of_a_task_are_bounded(spark):
    rows = spark.range(1000).selectExpr("id as k", "id % 7 as x")
    out = dealt(rows, "k", 50)
    assert out.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 100
    assert dealt(rows.limit(0), "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_key_of_many_rows_does_not_fill_one_task(spark):
    for key in ("7", "cast(null as long)"):
        rows = spark.range(1000).selectExpr(f"if(id < 900, {key}, id) as k", "id")
        out = dealt(rows, "k", 100)
        assert out.count() == 1000
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 300


@pytest.fixture(scope="module")
def customers(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("many")
    given = spark.read.parquet(f"{sf}/customer.parquet").limit(100)
    span = spark.range(-(-TASK_ROWS * 6 // 100)).withColumnRenamed("id", "copy")
    copies = given.crossJoin(span).withColumn("c_custkey", F.col("c_custkey") + F.col("copy") * 1_000_000).drop("copy")
    copies.coalesce(2).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["gen_records_check", "key_path_overlap", "score_json", "score_json_leaves"])
def test_more_documents_take_more_tasks(spark, customers, name):
    """All documents went to as many tasks as there were cores, however many they were."""
    assert QUERIES[name](spark, customers).rdd.getNumPartitions() >= 6
