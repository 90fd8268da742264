"""Inputs of the registered queries, derived from the given tables, and the same inputs as SQL.

Each function returns a frame; the SQL constant of the same subject holds the same rows as a CTE body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesieve.sources.cells import cells_from_table

SOURCES = 20
BRANDS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- documents as tables of one text column, one table per source ----------------------------------

def doc_questions(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.concat(F.lit("src"), (F.col("item_id") % SOURCES).cast("string")).alias("corpus"),
        F.col("text").alias("question"),
    )


def doc_rows(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("corpus"), F.col("doc_id").alias("row_id"), "text")


def question_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def doc_vectors(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("corpus"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    return docs.join(vectors, "row_id").select("corpus", "row_id", "vector")


DOC_SQL = f"""
q AS (SELECT item_id AS qid, 'src' || (item_id % {SOURCES}) AS corpus, text AS question FROM benchmark),
r AS (SELECT source AS corpus, doc_id AS row_id, text FROM documents),
qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings),
rv AS (SELECT d.source AS corpus, e.vec_id AS row_id, e.embedding::DOUBLE[] AS v
       FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""


# -- parts as one table per brand, orders as one large table ----------------------------------------

PART_COLUMNS = ["p_partkey", "p_name", "Row Header", "p_type", "p_size", "p_retailprice"]
PART_FIELDS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def part_cells(spark, sf):
    part = table(spark, sf, "part").withColumn("Row Header", F.col("p_brand"))
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1)
    return cells_from_table(part, F.concat(F.lit("part-"), brand), F.col("p_partkey"), PART_COLUMNS)


def order_cells(spark, sf):
    return cells_from_table(table(spark, sf, "orders"), F.lit("orders-all"), F.col("o_orderkey"), ORDER_COLUMNS)


def all_cells(spark, sf):
    return part_cells(spark, sf).unionByName(order_cells(spark, sf))


def cell_sql(source: str, table_id: str, row_id: str, fields: list[str], names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {table_id} AS table_id, {row_id} AS row_id, {i} AS col_ord, '{n}' AS col_name, "
        f"CAST({f} AS VARCHAR) AS value FROM {source}"
        for i, (f, n) in enumerate(zip(fields, names))
    )


BRAND_ID = "'part-' || regexp_extract(p_brand, '([0-9]+)$', 1)"
PART_CELLS_SQL = "pc AS (" + cell_sql("part", BRAND_ID, "p_partkey", PART_FIELDS, PART_COLUMNS) + ")"
ORDER_CELLS_SQL = "oc AS (" + cell_sql("orders", "'orders-all'", "o_orderkey", ORDER_COLUMNS, ORDER_COLUMNS) + ")"
CELLS_SQL = f"{PART_CELLS_SQL}, {ORDER_CELLS_SQL}, c AS (SELECT * FROM pc UNION ALL SELECT * FROM oc)"


def part_questions(spark, sf):
    """One question per benchmark item about the parts of one brand, naming a part."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    named = table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), "p_name", "p_type", "p_size")
    return items.join(named, "qid", "left").select(
        "qid",
        F.concat(F.lit("part-"), (F.col("qid") % BRANDS + 1).cast("string")).alias("table_id"),
        F.concat_ws(" ", F.lit("Which"), "p_name", "p_type", F.lit("has size"), F.col("p_size").cast("string"), "text").alias("question"),
    )


PART_QUESTIONS_SQL = f"""
pq AS (SELECT item_id AS qid, 'part-' || (item_id % {BRANDS} + 1) AS table_id,
              concat_ws(' ', 'Which', p_name, p_type, 'has size', p_size::VARCHAR, text) AS question
       FROM benchmark LEFT JOIN part ON p_partkey = item_id)"""


def part_columns(spark, sf):
    """Columns of each question's table."""
    listed = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.lit(c).alias("col_name")) for i, c in enumerate(PART_COLUMNS)])
    return part_questions(spark, sf).select("qid", "table_id", F.inline(listed))


PART_COLUMNS_SQL = "pcol AS (SELECT qid, table_id, u.col_ord, u.col_name FROM pq, (" + " UNION ALL ".join(
    f"SELECT {i} AS col_ord, '{c}' AS col_name" for i, c in enumerate(PART_COLUMNS)
) + ") u)"


def part_responses(spark, sf):
    """Three scoring responses per question: a heading and one ``column: score`` line per column."""
    rounds = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("iteration")
    lines = F.array(
        *[
            F.concat(F.lit(f"{c}: "), (((F.col("qid") * 7 + i * 3 + F.col("iteration") * 2) % 11) / 10).cast("string"))
            for i, c in enumerate(PART_COLUMNS)
        ]
    )
    return part_questions(spark, sf).select("qid", rounds).select(
        "qid", "iteration", F.concat(F.lit("Question: see below\n"), F.array_join(lines, "\n")).alias("text")
    )


PART_VOTES_SQL = """
pv AS (SELECT qid, col_ord, col_name, iteration, ((qid * 7 + col_ord * 3 + iteration * 2) % 11) / 10.0::DOUBLE AS score
       FROM pcol, (SELECT unnest([0, 1, 2]) AS iteration))"""


def part_question_vectors(spark, sf):
    asked = part_questions(spark, sf).select("qid", "table_id")
    return asked.join(question_vectors(spark, sf), "qid").select("qid", "table_id", "vector")


def part_column_vectors(spark, sf):
    """One vector per column of each brand's table."""
    cells = part_cells(spark, sf).select("table_id", "col_ord", "col_name").distinct()
    number = F.regexp_extract("table_id", "([0-9]+)$", 1).cast("long") * len(PART_COLUMNS) + F.col("col_ord")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("number"), F.col("embedding").alias("vector"))
    return cells.withColumn("number", number).join(vectors, "number").select("table_id", "col_ord", "col_name", "vector")


PART_SIM_SQL = f"""
pcv AS (SELECT t.table_id, t.col_ord, t.col_name, e.embedding::DOUBLE[] AS v
        FROM (SELECT DISTINCT table_id, col_ord, col_name FROM pc) t
        JOIN embeddings e ON e.vec_id = regexp_extract(t.table_id, '([0-9]+)$', 1)::BIGINT * {len(PART_COLUMNS)} + t.col_ord),
pqv AS (SELECT pq.qid, pq.table_id, e.embedding::DOUBLE[] AS v FROM pq JOIN embeddings e ON e.vec_id = pq.qid),
psim0 AS (SELECT a.qid, b.col_ord, b.col_name, coalesce(list_cosine_similarity(a.v, b.v), 0) AS s
          FROM pqv a JOIN pcv b USING (table_id)),
psim AS (SELECT qid, col_ord, col_name,
                CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE s END AS sim
         FROM psim0 WINDOW w AS (PARTITION BY qid))"""


def part_row_vectors(spark, sf):
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("part-"), F.regexp_extract("p_brand", "([0-9]+)$", 1)).alias("table_id"), F.col("p_partkey").alias("row_id")
    )
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    return rows.join(vectors, "row_id").select("table_id", "row_id", "vector")


PART_ROW_VECTORS_SQL = f"""
prv AS (SELECT {BRAND_ID} AS table_id, p_partkey AS row_id, e.embedding::DOUBLE[] AS v
        FROM part JOIN embeddings e ON e.vec_id = p_partkey)"""


def part_essential(spark, sf):
    """Responses naming the columns a question needs: two list styles and one that is no list."""
    text = (
        F.when(F.col("qid") % 3 == 0, '["p_size", "p_name"]')
        .when(F.col("qid") % 3 == 1, " ['p_type', 'nowhere',] ")
        .otherwise("I would take all of them")
    )
    return part_questions(spark, sf).select("qid", text.alias("text"))


PART_ESSENTIAL_SQL = """
pe AS (SELECT qid, col_name, CASE WHEN qid % 3 = 2 THEN col_ord WHEN col_name = 'p_name' THEN 1 ELSE 0 END AS ess_ord
       FROM pcol WHERE (qid % 3 = 0 AND col_name IN ('p_size', 'p_name')) OR (qid % 3 = 1 AND col_name = 'p_type') OR qid % 3 = 2)"""

PART_ALL_SQL = ",".join(
    [PART_QUESTIONS_SQL, PART_CELLS_SQL, PART_COLUMNS_SQL, PART_VOTES_SQL, PART_SIM_SQL, PART_ROW_VECTORS_SQL, PART_ESSENTIAL_SQL]
)


# -- lineitem as score vectors: one question per order, one column per line number --------------------

def order_scores(spark, sf):
    number = F.col("l_linenumber").cast("string")
    flag = F.min("l_returnflag")
    name = F.when(F.min("l_linestatus") == "O", F.concat(F.lower(flag), number)).otherwise(
        F.concat_ws("_", flag, number, (F.col("l_linenumber") % 3).cast("string"))
    )
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("qid"), "l_linenumber")
        .agg(
            name.alias("col_name"),
            F.round(F.avg("l_discount") * 10, 9).alias("llm"),
            F.round(F.avg("l_quantity") / 50, 9).alias("sim"),
        )
        .select("qid", F.col("l_linenumber").alias("col_ord"), "col_name", "llm", "sim")
    )


def order_questions(spark, sf):
    text = (
        F.when(F.col("o_orderstatus") == "O", F.concat_ws(" ", F.lit("What is the total in"), "o_orderpriority", F.lit("and after"), F.col("o_custkey").cast("string")))
        .when(F.col("o_orderstatus") == "F", F.concat_ws(" ", F.lit("Which rows where"), "o_orderpriority"))
        .otherwise(F.concat_ws(" ", F.lit("Show"), "o_orderpriority", F.lit("rows")))
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), text.alias("question"))


ORDER_SCORES_SQL = """
cs AS MATERIALIZED (SELECT l_orderkey AS qid, l_linenumber AS col_ord,
       CASE WHEN min(l_linestatus) = 'O' THEN lower(min(l_returnflag)) || l_linenumber
            ELSE concat_ws('_', min(l_returnflag), l_linenumber::VARCHAR, (l_linenumber % 3)::VARCHAR) END AS col_name,
       round(avg(l_discount) * 10, 9) AS llm, round(avg(l_quantity) / 50, 9) AS sim
       FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
ORDER_QUESTIONS_SQL = """
oq AS (SELECT o_orderkey AS qid, CASE o_orderstatus
         WHEN 'O' THEN concat_ws(' ', 'What is the total in', o_orderpriority, 'and after', o_custkey::VARCHAR)
         WHEN 'F' THEN concat_ws(' ', 'Which rows where', o_orderpriority)
         ELSE concat_ws(' ', 'Show', o_orderpriority, 'rows') END AS question FROM orders)"""


def supplier_scores(spark, sf):
    """Wider vectors: up to 12 columns per supplier."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("qid"), (F.col("l_partkey") % 12).cast("int").alias("col_ord"))
        .agg(F.round(F.avg("l_discount") * 10, 9).alias("llm"), F.round(F.avg("l_quantity") / 50, 9).alias("sim"))
        .select("qid", "col_ord", F.concat(F.lit("c_"), F.col("col_ord").cast("string")).alias("col_name"), "llm", "sim")
    )


SUPPLIER_SCORES_SQL = """
ss AS (SELECT l_suppkey AS qid, (l_partkey % 12)::INTEGER AS col_ord, 'c_' || (l_partkey % 12) AS col_name,
       round(avg(l_discount) * 10, 9) AS llm, round(avg(l_quantity) / 50, 9) AS sim
       FROM lineitem GROUP BY l_suppkey, l_partkey % 12)"""


def customer_scores(spark, sf):
    """Tables of a hundred columns: runs of customers with two scores that form no clear groups."""
    number = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.floor(number / 100).cast("long").alias("qid"), (number % 100).cast("int").alias("col_ord"),
        F.concat(F.lit("c_"), (number % 100).cast("string")).alias("col_name"),
        F.round((F.col("c_acctbal") + 1000) / 11000, 9).alias("llm"), (number * 7919 % 1009 / 1009).alias("sim"),
    )


CUSTOMER_SCORES_SQL = """
cu AS (SELECT c_custkey // 100 AS qid, (c_custkey % 100)::INTEGER AS col_ord, 'c_' || (c_custkey % 100) AS col_name,
       round((c_acctbal + 1000) / 11000, 9) AS llm, (c_custkey * 7919 % 1009) / 1009.0::DOUBLE AS sim FROM customer)"""


def point_sets(spark, sf):
    """All customers and all parts as two sets of points."""
    customers = customer_scores(spark, sf).select(
        F.lit(0).cast("long").alias("qid"), (F.col("qid") * 100 + F.col("col_ord")).alias("col_ord"), "col_name", "llm", "sim"
    )
    parts = table(spark, sf, "part").select(
        F.lit(1).cast("long").alias("qid"), F.col("p_partkey").alias("col_ord"), F.col("p_name").alias("col_name"),
        F.round(F.col("p_retailprice") / 2000, 9).alias("llm"), (F.col("p_size") / 50).alias("sim"),
    )
    return customers.unionByName(parts)


POINT_SETS_SQL = CUSTOMER_SCORES_SQL + """,
big AS (SELECT 0::BIGINT AS qid, qid * 100 + col_ord AS col_ord, col_name, llm, sim FROM cu
        UNION ALL SELECT 1, p_partkey, p_name, round(p_retailprice / 2000, 9), p_size / 50.0::DOUBLE FROM part)"""


# -- events as votes, responses and runs ----------------------------------------------------------------

def event_votes_text(spark, sf):
    """One response per user and iteration: a heading and a ``type: score`` line per event, in order."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("qid"), (F.col("event_id") % 3).alias("iteration"), "event_id",
        F.concat("event_type", F.lit(": "), F.format_string("%.4f", F.col("value") / 100)).alias("line"),
    )
    lines = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda e: e.line)
    return events.groupBy("qid", "iteration").agg(
        F.concat(F.lit("Table scores: 1\n"), F.array_join(lines, "\n"), F.lit("\nnote without score")).alias("text")
    )


EVENT_VOTES_SQL = """
ev AS (SELECT user_id AS qid, event_id % 3 AS iteration, event_type AS col_name, event_id,
              printf('%.4f', value / 100)::DOUBLE AS score FROM events),
votes AS (SELECT qid, iteration, col_name, arg_max(score, event_id) AS score FROM ev
          WHERE score BETWEEN 0 AND 1 GROUP BY ALL),
vcol AS (SELECT qid, col_name, row_number() OVER (PARTITION BY qid ORDER BY col_name) AS col_ord
         FROM (SELECT DISTINCT user_id AS qid, event_type AS col_name FROM events)),
filled AS (SELECT c.qid, i.iteration, c.col_ord, c.col_name, coalesce(v.score, 0) AS score
           FROM vcol c JOIN (SELECT DISTINCT qid, iteration FROM votes) i USING (qid)
           LEFT JOIN votes v ON v.qid = c.qid AND v.iteration = i.iteration AND v.col_name = c.col_name)"""


def event_columns(spark, sf):
    from pyspark.sql import Window as W

    pairs = table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("col_name")).distinct()
    return pairs.withColumn("col_ord", F.row_number().over(W.partitionBy("qid").orderBy("col_name")))


def answer_responses(spark, sf):
    """Answers in all the shapes a response takes, and a failed run now and then."""
    kind, user = F.col("event_id") % 7, (F.col("user_id") % 10).cast("string")
    a = F.col("event_type")
    text = (
        F.when(kind == 0, F.concat(F.lit("no list here, only "), a))
        .when(kind == 1, F.concat(F.lit("['"), a, F.lit("'] then [\""), a, F.lit("\", null, "), user, F.lit("]")))
        .when(kind == 2, F.concat(F.lit("some [steps first\nANSWER: [\""), a, F.lit("\"]")))
        .when(kind == 3, F.concat(F.lit("rows:\n[[\""), a, F.lit("\"]]")))
        .when(kind == 4, F.concat(F.lit("[1 [\""), a, F.lit("\"]\n[[ bad\npredicted_answer_entity: "), a, F.lit(", so\n")))
        .when(kind == 5, F.concat(F.lit("Answer: [\""), F.upper(a), F.lit(" \", \""), user, F.lit("\"]")))
        .otherwise(F.concat(F.lit("Answer: [\""), a, F.lit("\"] {\"predicted_answer_entity\": \"kind "), user, F.lit("\"}")))
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("qid"),
        F.concat(F.lit("method"), (F.col("user_id") % 3).cast("string")).alias("method"),
        text.alias("text"),
        F.when(F.col("event_id") % 11 == 0, "failed").otherwise("ok").alias("status"),
    )


ANSWERS_SQL = """
resp AS (SELECT event_id AS qid, 'method' || (user_id % 3) AS method, event_type AS a, (user_id % 10)::VARCHAR AS u,
                event_id % 7 AS kind, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events),
ans AS (SELECT qid, method, status, CASE kind
          WHEN 0 THEN ['Answer not found in the table.']
          WHEN 1 THEN [a, 'None', u]
          WHEN 2 THEN [a]
          WHEN 3 THEN ['["' || a || '"]']
          WHEN 4 THEN ['Answer not found in the table.']
          WHEN 5 THEN [upper(a) || ' ', u]
          ELSE [a] END AS answers,
        CASE kind WHEN 4 THEN a WHEN 6 THEN 'kind ' || u END AS answer_type FROM resp)"""


def gold_answers(spark, sf):
    """Gold answers of an event: its type, and for some the user's digit too."""
    user = (F.col("user_id") % 10).cast("string")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("qid"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.col("event_type"), user)).otherwise(F.array(F.col("event_type"))).alias("answers"),
    )


GOLD_SQL = """
gold AS (SELECT event_id AS qid, CASE WHEN event_id % 2 = 0 THEN [event_type, (user_id % 10)::VARCHAR] ELSE [event_type] END AS answers
         FROM events)"""
