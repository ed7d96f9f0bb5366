"""Forests' weights come to the rows, so that a class's rows don't gather in one task."""

from pyspark.sql import functions as F

from sigloom.plans import models


def test_a_class_is_not_one_tasks_work(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, "1").otherwise("0").alias("label")).repartition(6, "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = models.balanced(rows, "label").withColumn("part", F.spark_partition_id())
        held = {(r["label"], r["weight"]): r["n"] for r in out.groupBy("label", "weight").agg(F.countDistinct("part").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(k, round(w, 9)) for k, w in held} == {("1", 5.0), ("0", round(4000 / 7200, 9))} and min(held.values()) > 3
