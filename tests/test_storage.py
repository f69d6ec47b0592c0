import os

import pandas as pd
from pyspark.sql import functions as F

from tickloom.plans import storage


def test_costly_plans_are_told_by_their_nodes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("Join_Sort_Window", F.col("id") * 2).write.parquet(path)
    scan = spark.read.parquet(path)
    for plain in (scan, scan.where("id > 2").select("Join_Sort_Window"), scan.unionByName(scan)):
        assert not storage.costly(plain) and storage.once(plain) is plain
    grouped = scan.groupBy("id").count()
    python = scan.mapInPandas(lambda it: it, scan.schema)
    udf = scan.select(F.pandas_udf(lambda s: s + 1, "bigint")("id").alias("x"))
    for costly in (grouped, scan.join(grouped, "id"), scan.orderBy("id"), scan.repartition(3), scan.select(F.explode(F.array("id"))), python, udf):
        assert storage.costly(costly)
        assert not storage.costly(storage.once(costly))


def test_stored_tables_are_deleted_on_request(spark):
    before = list(storage._stored)
    storage._stored.clear()
    kept = storage.cut(spark.range(5))
    (path,) = storage._stored
    assert kept.count() == 5 and os.path.exists(path.removeprefix("file://"))
    assert storage.clear_stored(spark) == 1
    assert not os.path.exists(path.removeprefix("file://"))
    storage._stored.extend(before)


def test_a_column_without_a_type_is_kept(spark):
    rows = storage.cut(spark.createDataFrame(pd.DataFrame({"a": [1]})).withColumn("n", F.lit(None))).collect()
    assert [tuple(r) for r in rows] == [(1, None)]
