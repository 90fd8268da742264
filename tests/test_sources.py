"""Large documents, stored cells, scorers that fail, similarity on text, streams that repeat themselves."""

import json

import pytest
from pyspark.sql import functions as F

from tablesieve.operators import similarity as si
from tablesieve.plans import scoring as pg
from tablesieve.runtime import scratch_path
from tablesieve.sources import cells as sc, documents as sd, questions as sq, stored as st
from tablesieve.streaming.resume import run_pending

DOCUMENTS = {
    "plain": {"question": {"0": "who?", "1": "what?"}, "answer": {"0": "a", "1": ["b", 7]}, "original_table_id": {"0": "t-1", "1": "t-2"}},
    "odd strings": {
        "question": {str(i): q for i, q in enumerate(['say "hi"', "back\\slash", '\\"', "", "{}[],:", "line\nbreak\ttab", '": {"', "é 😀  ", "a" * 5000])},
        "answer": {"0": None, "1": 3.5, "2": [], "3": ["x", None], "4": True, "5": "[not a list", "6": '["quoted", "list"]', "8": "last"},
        "original_table_id": {"8": "only-this"},
    },
    "nested": {"question": {"5": "deep"}, "answer": {"5": [["a", {"b": "c, d}"}], "e"]}, "extra": {"5": {"x": {"y": [1, "}"]}}, "6": 1}},
    "no entries": {"question": {}, "answer": {}, "original_table_id": {}},
}


def written(tmp_path, name, indent):
    path = tmp_path / f"{abs(hash(name))}.json"
    path.write_text(json.dumps(DOCUMENTS[name], indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    return f"file://{path}"


@pytest.mark.parametrize("name", DOCUMENTS)
@pytest.mark.parametrize("indent", [None, 3])
def test_entries_of_a_document(spark, tmp_path, name, indent):
    found = {(r.field, r["index"]): json.loads(r.value) for r in sd.read_entries(spark, written(tmp_path, name, indent)).collect()}
    assert found == {(f, i): v for f, entries in DOCUMENTS[name].items() for i, v in entries.items()}


def test_a_document_in_many_pieces(spark, tmp_path):
    """The file is cut by the reader in the middle of strings and names."""
    many = {f: {str(i): f"{f} {i} \\ \"{'x' * (i % 97)}\"" for i in range(400)} for f in ("question", "answer", "original_table_id")}
    (tmp_path / "many.json").write_text(json.dumps(many, indent=1), encoding="utf-8")
    keys = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1"}
    saved = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = sd.read_large_questions(spark, f"file://{tmp_path}/many.json").collect()
        assert spark.read.text(f"file://{tmp_path}/many.json").rdd.getNumPartitions() > 8
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert {r.qid: (r.question, r.answers) for r in found} == {i: (many["question"][str(i)], [many["answer"][str(i)]]) for i in range(400)}


def test_same_as_the_small_reader(spark, tmp_path):
    path = written(tmp_path, "plain", 2)
    columns = ["qid", "table_id", "question", "answers"]
    large, small = sd.read_large_questions(spark, path), sq.read_questions(spark, path, whole_files=True)
    assert sorted(map(str, large.select(columns).collect())) == sorted(map(str, small.select(columns).collect()))


CELLS = "table_id string, row_id long, col_ord int, col_name string, value string"


def test_stored_cells_are_pruned_while_the_query_runs(spark):
    path = scratch_path(spark, "stored-test")
    rows = [(f"t{t}", r, c, f"c{c}", f"{t}.{r}.{c}") for t in range(60) for r in range(5) for c in range(2)] + [("hot", r, 0, "c", None) for r in range(3000)]
    cells = spark.createDataFrame(rows, CELLS)
    st.store_cells(cells, path, buckets=32, slice_cells=1000)
    asked = spark.createDataFrame([(1, "t7"), (2, "t7"), (3, "hot"), (4, "lost"), (5, None), (6, "")], "qid long, table_id string")
    found = st.fetch_stored(spark, path, asked, buckets=32)
    want = sc.fetch_tables(asked, cells)
    assert sorted(map(str, found.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    st.store_cells(spark.createDataFrame([("new", 1, 0, "c", "v")], CELLS), path, buckets=32, mode="append")
    assert st.fetch_stored(spark, path, spark.createDataFrame([(1, "new")], "qid long, table_id string"), buckets=32).count() == 1


def test_errors_end_their_question_alone(spark):
    def scorer(question, names):
        match question:
            case "raise":
                raise KeyError("gone")
            case "short":
                return [1.0]
            case "nan":
                return [float("nan")] * len(names)
            case "text":
                return ["1.5"] * len(names)
            case "none":
                return None
        return [len(n) + len(question or "") for n in names]

    texts = ["fine", "raise", "short", "nan", "text", "none", None, "no columns"]
    asked = spark.createDataFrame(list(enumerate(texts)), "qid long, question string")
    columns = spark.createDataFrame([(q, c, "ab"[c] * (c + 1)) for q in range(7) for c in (1, 0)], "qid long, col_ord int, col_name string")
    scored = pg.score_columns(asked.repartition(2), columns, scorer)
    found = {r.qid: r for r in scored.collect()}
    assert [found[q].status for q in range(8)] == ["ok", "failed", "failed", "failed", "ok", "failed", "ok", "ok"]
    assert [(c.col_ord, c.col_name, c.score) for c in found[0].columns] == [(0, "a", 5.0), (1, "bb", 6.0)]
    assert found[1].error == "KeyError: 'gone'" and found[1].columns is None and "1 scores for 2" in found[2].error
    assert {r.qid for r in pg.scored_columns(scored).collect()} == {0, 4, 6}


def test_text_stands_in_for_vectors(spark):
    questions = spark.createDataFrame([(1, "a", "price of red"), (2, "a", "price of red"), (3, "b", "x"), (4, "a", "")], "qid long, table_id string, question string")
    described = spark.createDataFrame([("a", 0, "p_price", "Price in euro"), ("a", 1, "p_colour", "red or green"), ("a", 2, "p_size", None), ("b", 0, "x", "x")],
                                      "table_id string, col_ord int, col_name string, description string")
    asked = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", None), (3, "b", [1.0, 0.0])], "qid long, table_id string, vector array<double>")
    columns = spark.createDataFrame([("a", 0, "p_price", [0.0, 1.0]), ("a", 1, "p_colour", [1.0, 0.0]), ("a", 2, "p_size", [1.0, 1.0])],
                                    "table_id string, col_ord int, col_name string, vector array<double>")
    found = {}
    for r in si.question_similarity(questions, described, asked, columns).collect():
        found.setdefault((r.qid, r.basis), {})[r.col_name] = r.sim
    assert set(found) == {(1, "vector"), (2, "text"), (3, "text"), (4, "text")}
    assert found[1, "vector"]["p_colour"] == 1.0 and found[2, "text"]["p_size"] == 0.0
    assert max(found[2, "text"].values()) == 1.0 and set(found[4, "text"].values()) == {0.0}


def test_a_question_that_arrives_again_is_worked_once(spark):
    source, target, state = (scratch_path(spark, n) for n in ("drops", "done", "seen"))
    worked = []
    for drop in ([1, 2, 2], [2, 3], [1, 3], [4]):
        spark.createDataFrame([(q, f"q{q}") for q in drop], "qid long, text string").write.mode("append").parquet(source)
        run_pending(spark, source, "qid long, text string", lambda batch: batch, target, state, key="qid").awaitTermination()
        worked.append(sorted(r.qid for r in spark.read.schema("qid long, text string").json(target).collect()))
    assert worked == [[1, 2], [1, 2, 3], [1, 2, 3], [1, 2, 3, 4]]
