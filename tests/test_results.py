"""Records: resume, last record, failures, and runs that go on where they ended."""

from pyspark.sql import functions as F

from tablesieve.sources import results as sr
from tablesieve.streaming.resume import run_pending


def test_last_result_pending_and_failures(spark):
    runs = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "qid long, run_seq long, v string")
    assert sorted(tuple(r) for r in sr.last_results(runs).collect()) == [(1, 3, "c"), (2, 1, "z")]
    todo = spark.range(1, 5).withColumnRenamed("id", "qid")
    assert sorted(r.qid for r in sr.pending(todo, runs).collect()) == [3, 4]
    good, bad = sr.split_failures(spark.createDataFrame([(1, None), (2, "boom")], "qid long, error string"))
    assert good.columns == ["qid"] and [r.qid for r in bad.collect()] == [2]


def test_rounding_leaves_cells_alone(spark):
    frame = spark.createDataFrame([(1, 0.123456, "0.123456")], "qid long, score double, value string")
    assert tuple(sr.round_scores(frame).collect()[0]) == (1, 0.1235, "0.123456")


def test_runs_go_on_where_they_ended(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    work = lambda batch: batch.withColumn("double", F.col("qid") * 2)
    for start in (0, 5):
        spark.range(start, start + 5).withColumnRenamed("id", "qid").write.mode("append").parquet(source)
        run_pending(spark, source, "qid long", work, target, state).awaitTermination()
    records = sr.read_results(spark, target, "qid long, double long, run_seq long").collect()
    assert sorted((r.qid, r.double) for r in records) == [(i, 2 * i) for i in range(10)]
    assert len({r.run_seq for r in records}) == 2
