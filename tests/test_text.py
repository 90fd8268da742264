"""Cell text, tokens, response parsing and text forms."""

from collections import Counter

from pyspark.sql import functions as F, types as T

from tablesieve.functions import text as tx
from tablesieve.operators import linearize as ln, responses as rs
from tablesieve.sources import cells as sc, questions as sq


def test_cell_text(spark):
    values = [0.1, 900.0, 12345678.5, 1e16, 1.5e-7, 0.00012, -2.0, 1e15, float("nan"), None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in frame.select("i", tx.cell_text(F.col("v"), T.DoubleType()).alias("t")).orderBy("i").collect()]
    assert got == [None if v is None else repr(v) for v in values]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    assert [r[0] for r in flags.select(tx.cell_text(F.col("v"), T.BooleanType())).collect()] == ["True", "False", None]


def test_term_counts(spark):
    texts = ["b a b c a b", "", "one", "x x x"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", tx.term_counts(tx.space_tokens(F.col("t"))).alias("c")).collect():
        assert {c.term: c.tf for c in row.c} == Counter(row.t.split())


def test_json_value_rejects_anything_after_it(spark):
    texts = ['["a", 1, null]', '["a"] x ["b"]', '["a"]} x', "['a']", '[["a"]]', "{}", "[", ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in frame.select("i", tx.json_value(F.col("t"), "array<string>").alias("v")).orderBy("i").collect()]
    assert got == [["a", "1", None], None, None, None, ['["a"]'], None, None, None]


def test_answers(spark):
    cases = {
        'so [x] and ["a", "b"] or ["c"]': ["a", "b"],
        'broken [x ANSWER: ["a"]': ["a"],
        'lines\n[["a"]]\nno more': ['["a"]'],
        '["a"]\nignored ["b"]': ["a"],
        "nothing": ["Answer not found in the table."],
        "[1, null, true]": ["1", "None", "true"],
    }
    frame = spark.createDataFrame([(k,) for k in cases], "text string")
    for row in rs.answers(frame).collect():
        assert row.answers == cases[row.text], row.text


def test_essential_columns(spark):
    columns = spark.createDataFrame([(q, i, c) for q in range(5) for i, c in enumerate("abc")], "qid long, col_ord int, col_name string")
    texts = ['["c", "a", "zzz"]', "['b',]", "[1, 2]", "c, a", "[]"]
    frame = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    got = {}
    for r in rs.essential_columns(frame, columns).orderBy("qid", "ess_ord").collect():
        got.setdefault(r.qid, []).append(r.col_name)
    assert got == {0: ["c", "a"], 1: ["b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"]}


def test_long_lists_of_essential_columns(spark):
    names = ["n" * 100_000, *[f"c{i}" for i in range(10_000)]]
    quoted = lambda q: "[" + ", ".join(q + n + q for n in names) + "]"
    responses = spark.createDataFrame(
        [(1, quoted('"')), (2, quoted("'")), (3, quoted('"')[:-1]), (4, '["a\\"' + "x" * 100_000 + '"]'), (5, "[" * 100_000), (6, '["c1",]'),
         (7, '["c1" "c2"]')], "qid long, text string")
    columns = spark.createDataFrame([(q, i, c) for q in range(1, 8) for i, c in enumerate(["c9999", "c1", names[0]])],
                                    "qid long, col_ord int, col_name string")
    got = {}
    for r in rs.essential_columns(responses, columns).collect():
        got.setdefault(r.qid, []).append((r.ess_ord, r.col_name))
    listed = [(0, names[0]), (2, "c1"), (10_000, "c9999")]
    everything = [(0, "c9999"), (1, "c1"), (2, names[0])]
    assert {q: sorted(v) for q, v in got.items()} == {1: listed, 2: listed, 3: everything, 5: everything, 6: [(0, "c1")], 7: everything}


def test_parts_put_together_are_the_whole_text(spark):
    df = spark.createDataFrame([(i, f"v{i}", None if i % 3 else "x|y") for i in range(7)], "id long, a string, `b c` string")
    cells = sc.cells_from_table(df, F.lit("t"), F.col("id"), ["a", "b c"]).withColumnRenamed("col_ord", "pos")
    rows = [(f"v{i}", "None" if i % 3 else "x|y") for i in range(7)]
    whole = {
        ln.ROWS: " | ".join(f"a: {a}; b c: {b}" for a, b in rows),
        ln.HEADER: "\n".join(["a | b c", *[f"{a} | {b}" for a, b in rows]]),
        ln.FLAT: "a | b c " + "".join(f"{a} | {b} " for a, b in rows),
        ln.TSV: "a\tb c\n" + "".join(f"{a}\t{b}\n" for a, b in rows),
    }
    for form, want in whole.items():
        parts = ln.table_text(cells, ["table_id"], "row_id", form, rows_per_part=3).orderBy("part").collect()
        assert form.between.join(p.text for p in parts) == want


def test_question_documents(spark, tmp_path):
    (tmp_path / "q.json").write_text('{\n"question": {"0": "q?", "7": "r?"},\n"answer": {"0": ["a", "b"], "7": 3},\n"original_table_id": {"0": "1-2", "7": "x"}}')
    got = {r.qid: r for r in sq.read_questions(spark, str(tmp_path), whole_files=True).collect()}
    assert got[0].answers == ["a", "b"] and got[0].table_id == "table_1_2" and got[7].answers == ["3"]
