"""Whole runs: hot tables, status of every question, ablation parts that line up."""

from pyspark.sql import functions as F

from tablesieve.operators import linearize as ln
from tablesieve.plans import ablation as ab, filter as fl, records as pc
from tablesieve.runtime import materialize
from tablesieve.sources import cells as sc

CELLS = "table_id string, row_id long, col_ord int, col_name string, value string"


def test_a_hot_table_is_split_by_its_size(spark):
    """Nine tenths of the cells belong to one table; adaptive execution splits it, nothing is repeated by hand."""
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.shuffle.partitions": "16",
    }
    saved = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        name = F.when(F.col("id") % 10 == 0, F.concat(F.lit("t"), (F.col("id") % 70).cast("string"))).otherwise("hot")
        cells = materialize(spark.range(0, 60_000, 1, 8).select(
            name.alias("table_id"), F.col("id").alias("row_id"), F.lit(0).alias("col_ord"), F.lit("c").alias("col_name"),
            F.sha2(F.col("id").cast("string"), 256).alias("value")))
        asked = spark.createDataFrame([(1, "hot"), (2, "t10"), (3, "t20")], "qid long, table_id string")
        found = sc.fetch_tables(asked, cells)
        assert found.agg(F.sum(F.length("value"))).first()[0] > 0
        counted = found.groupBy("qid").agg(F.max("value"))
        assert {r.qid for r in counted.collect()} == {1, 2, 3}
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_status_of_every_question(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "lost"), (3, "a"), (4, "a"), (5, "lost")], "qid long, table_id string")
    cells = spark.createDataFrame([("a", 1, 0, "c", "v")], CELLS)
    scores = spark.createDataFrame(
        [(1, 0.1, 0.1), (1, 0.2, 0.2), (1, 0.3, 0.3), (2, 0.1, 0.1), (4, 0.5, 0.5), (4, 0.5, 0.5)], "qid long, llm double, sim double")
    found = {r.qid: (r.status, r.reason) for r in pc.question_status(questions, cells, scores).collect()}
    assert found == {1: ("ok", "ok"), 2: ("failed", "no_table"), 3: ("failed", "no_scores"), 4: ("ok", "few_points"), 5: ("failed", "no_table")}


def test_parts_of_the_three_tables_line_up(spark):
    """Row ids are sparse and tables differ in length: part k holds the same stretch of each."""
    schema = "qid long, {} long, pos int, col_name string, value string"
    by_id = spark.createDataFrame([(1, i * 1009, 0, "a", f"i{i}") for i in range(7)], schema.format("row_id"))
    by_rank = spark.createDataFrame([(1, i + 1, 0, "a", f"r{i}") for i in range(5)], schema.format("rnk"))
    top = spark.createDataFrame([(1, i + 1, p, n, f"t{i}") for i in range(3) for p, n in enumerate("ab")], schema.format("rnk"))
    asked = spark.createDataFrame([(1, "why", "so")], "qid long, question string, answer string")
    rows = {r.part: r for r in ab.side_by_side(asked, by_id, by_rank, top, 3).collect()}
    assert sorted(rows) == [1, 2, 3]
    assert [rows[p].column_filtered for p in (1, 2, 3)] == [
        '[{"a":"i0"},{"a":"i1"},{"a":"i2"}]', '[{"a":"i3"},{"a":"i4"},{"a":"i5"}]', '[{"a":"i6"}]']
    assert rows[1].row_filtered == '[{"a":"r0"},{"a":"r1"},{"a":"r2"}]' and rows[3].row_filtered is None
    assert rows[1].top_filtered.count("{") == 3 and rows[2].top_filtered is None
    assert all((r.question, r.answer, r.top_columns) == ("why", "so", ["a", "b"]) for r in rows.values())


def test_cells_are_tokenised_like_their_rows(spark):
    from tablesieve.operators import rows as rw

    cells = spark.createDataFrame(
        [("t", 1, 0, "a", "Red apple"), ("t", 1, 1, "b", None), ("t", 2, 0, "a", "apple,"), ("t", 2, 1, "b", "x pie pie")], CELLS)
    columns = spark.createDataFrame([("k", "t", 0, "a"), ("k", "t", 1, "b"), ("m", "t", 0, "b")], "corpus string, table_id string, pos int, col_name string")
    texts = fl.row_text(cells.join(columns, ["table_id", "col_name"]), ["corpus", "row_id"])
    listed = lambda f: sorted(tuple(r) for r in f.where(F.col("kind") != rw.MARK).select("corpus", "row_id", "kind", "term", "tf", "len").collect())
    assert listed(fl.corpus_postings(cells, columns)) == listed(rw.postings(texts))


def test_no_table_is_seen_from_the_cells(spark):
    cells = spark.createDataFrame([("a", 1, 0, "c", "v")], CELLS).withColumnRenamed("col_ord", "pos")
    wanted = spark.createDataFrame([("a",), ("b",)], "table_id string")
    text = ln.or_no_table(ln.table_text(cells, ["table_id"], "row_id", ln.HEADER), cells, wanted, ["table_id"])
    assert {r.text for r in text.where("table_id = 'b'").collect()} == {ln.NO_TABLE}
    assert "NestedLoop" not in text._jdf.queryExecution().executedPlan().toString()
