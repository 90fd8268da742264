"""Session settings keep tasks small."""

from pyspark.sql import functions as F


def test_partitions_are_not_put_together_into_large_ones(spark):
    """Incompressible rows of about 50 MB, dealt by a key: adaptive execution leaves them in several tasks."""
    name = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    saved = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")
        rows = spark.range(400_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
        dealt = rows.repartition("id").withColumn("p", F.spark_partition_id())
        dealt = dealt.groupBy("p").agg(F.count("*").alias("count"), F.max("text")).collect()
    finally:
        spark.conf.set(name, saved)
    assert sum(r["count"] for r in dealt) == 400_000 and len(dealt) > 2 and max(r["count"] for r in dealt) < 200_000
