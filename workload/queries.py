"""The registered queries and their SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesieve.functions import questions as qf
from tablesieve.functions.text import json_value
from tablesieve.operators import (
    choose, clusters as cl, columns as co, index as ix, linearize as ln, point_sets as ps, profile as pr,
    responses as rs, rows as rw, similarity as si, votes as vo,
)
from tablesieve.plans import ablation as ab, evaluation as pe, filter as fl, records as pc, runs, scoring as pg
from tablesieve.runtime import materialize, scratch_path, tune
from tablesieve.sources import cells as sc, documents as sd, questions as sq, results as sr, stored as st
from tablesieve.streaming.resume import run_pending
from workload import frames as fx, sql

BLOCK = 1000
PER_PART = 50

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            # rounds of clustering are a recursive body
            SQL[name] = oracle.replace("WITH ", "WITH RECURSIVE ", 1) if "km AS (" in oracle else oracle
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    return sr.round_scores(df, 6)


# -- sources and sinks -----------------------------------------------------------------------------------

@register("question_scan", """SELECT item_id AS qid, 'table_part_' || (item_id % 25 + 1) AS table_id, text AS question,
    CASE WHEN item_id % 2 = 0 THEN 'yes' ELSE 'no;7' END AS answers FROM benchmark""")
def question_scan(spark, sf):
    """Write the benchmark as column-oriented JSON documents and read them as a question set."""
    items = fx.table(spark, sf, "benchmark")
    key = F.col("item_id").cast("string")

    def field(value):
        return F.map_from_entries(F.collect_list(F.struct(key, value)))

    answer = F.when(F.col("item_id") % 2 == 0, F.lit("yes")).otherwise(F.lit('["no", 7]'))
    docs = items.groupBy(F.floor(F.col("item_id") / 16)).agg(
        F.to_json(
            F.struct(
                field(F.col("text")).alias("question"),
                field(answer).alias("answer"),
                field(F.concat(F.lit("part-"), (F.col("item_id") % 25 + 1).cast("string"))).alias("original_table_id"),
            )
        ).alias("value")
    )
    path = scratch_path(spark, "questions")
    docs.select("value").write.text(path)
    return sq.read_questions(spark, path).withColumn("answers", F.array_join("answers", ";"))


@register("question_document", """SELECT item_id AS qid, 'table_part_' || (item_id % 25 + 1) AS table_id, text || chr(10) || '"' || item_id || '\\' AS question,
    CASE WHEN item_id % 2 = 0 THEN 'yes' ELSE 'no;7' END AS answers FROM benchmark""")
def question_document(spark, sf):
    """The whole benchmark as one JSON document over many lines, read in pieces by many tasks."""
    items = fx.table(spark, sf, "benchmark").withColumn("key", F.to_json(F.array(F.col("item_id").cast("string"))))
    key = F.regexp_replace("key", r"^\[|\]$", F.lit(""))

    def text_of(value):
        return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", F.lit(""))

    question = F.concat("text", F.lit('\n"'), F.col("item_id").cast("string"), F.lit("\\"))
    answer = F.when(F.col("item_id") % 2 == 0, F.lit('"yes"')).otherwise(F.lit('["no", 7]'))
    table_id = F.concat(F.lit("part-"), (F.col("item_id") % 25 + 1).cast("string"))
    low, high = items.agg(F.min("item_id"), F.max("item_id")).first()
    lines = None
    for number, (field, value) in enumerate({"question": text_of(question), "answer": answer, "original_table_id": text_of(table_id)}.items()):
        ends = F.when(F.col("item_id") == high, F.lit("\n }" + (",\n" if number < 2 else "\n}"))).otherwise(F.lit(","))
        starts = F.when(F.col("item_id") == low, F.lit(("{\n" if number == 0 else "") + f' "{field}": {{\n')).otherwise(F.lit(""))
        entry = F.concat(starts, F.lit("  "), key, F.lit(": "), value, ends)
        part = items.select(F.lit(number).alias("field"), "item_id", entry.alias("value"))
        lines = part if lines is None else lines.unionByName(part)
    path = scratch_path(spark, "document")
    # one file, as such documents come
    lines.coalesce(1).sortWithinPartitions("field", "item_id").select("value").write.text(path)
    return sd.read_large_questions(spark, path).withColumn("answers", F.array_join("answers", ";"))


@register("table_fetch_stored", f"""WITH {fx.PART_QUESTIONS_SQL}, {fx.CELLS_SQL}
    SELECT qid, 'table_' || replace(table_id, '-', '_') AS table_id, row_id, col_ord, col_name, value FROM pq JOIN c USING (table_id)""")
def table_fetch_stored(spark, sf):
    """Cells of each question's table from a folder laid out by table, of which the asked buckets are read."""
    name = sq.table_name(F.col("table_id"))
    path = scratch_path(spark, "cells")
    st.store_cells(materialize(fx.all_cells(spark, sf).withColumn("table_id", name), "cells"), path)
    asked = fx.part_questions(spark, sf).select("qid", name.alias("table_id"))
    return st.fetch_stored(spark, path, asked).select("qid", "table_id", "row_id", "col_ord", "col_name", "value")


@register("table_fetch", f"""WITH {fx.PART_QUESTIONS_SQL}, {fx.PART_CELLS_SQL},
    pairs AS (SELECT qid, table_id FROM pq UNION ALL SELECT DISTINCT 1000000, 'missing-1' FROM pq)
    SELECT p.qid, 'table_' || replace(p.table_id, '-', '_') AS table_id, coalesce(row_id, -1) AS row_id, coalesce(col_ord, -1) AS col_ord,
           col_name, value, CASE WHEN row_id IS NULL THEN 'no_table' ELSE 'ok' END AS status
    FROM pairs p LEFT JOIN pc USING (table_id)""")
def table_fetch(spark, sf):
    """Cells of each question's table by normalised id; an unknown table is reported, not lost."""
    asked = fx.part_questions(spark, sf).select("qid", "table_id")
    lost = asked.select(F.lit(1000000).cast("long").alias("qid"), F.lit("missing-1").alias("table_id")).distinct()
    asked = asked.unionByName(lost).withColumn("table_id", sq.table_name(F.col("table_id")))
    cells = fx.part_cells(spark, sf).withColumn("table_id", sq.table_name(F.col("table_id")))
    found = sc.fetch_tables(asked, cells).withColumn("status", F.lit("ok"))
    missing = sc.table_status(asked, cells).where(F.col("status") == "no_table").select(
        "qid", "table_id", F.lit(-1).cast("long").alias("row_id"), F.lit(-1).alias("col_ord"),
        F.lit(None).cast("string").alias("col_name"), F.lit(None).cast("string").alias("value"), "status",
    )
    return found.unionByName(missing)


@register("cell_lookup", f"""WITH {fx.PART_CELLS_SQL}, {fx.PART_QUESTIONS_SQL}
    SELECT e.event_id AS qid, pc.table_id, pc.row_id, pc.col_ord, pc.value
    FROM events e JOIN pc ON pc.row_id = e.user_id AND pc.col_ord = e.event_id % 6""")
def cell_lookup(spark, sf):
    """Values at (row, column) places given by the events."""
    places = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("qid"), F.col("user_id").alias("row_id"), (F.col("event_id") % 6).cast("int").alias("col_ord")
    )
    tables = fx.part_cells(spark, sf).select("table_id", "row_id").distinct()
    return sc.lookup(places.join(tables, "row_id"), fx.part_cells(spark, sf)).select(
        "qid", "table_id", "row_id", "col_ord", "value"
    )


@register("result_roundtrip", """SELECT event_id AS qid, user_id, event_type, round(value, 4) AS value, event_type AS model,
    (event_id % 2)::INTEGER AS em, round(value / 10, 4) AS f1 FROM events""")
def result_roundtrip(spark, sf):
    """Append records as JSON lines and scores as CSV in two runs, read both back and join them."""
    events = fx.table(spark, sf, "events")
    jsonl, csv = scratch_path(spark, "results"), scratch_path(spark, "scores")
    for even in (0, 1):
        half = events.where(F.col("event_id") % 2 == even)
        record = half.select(F.col("event_id").alias("qid"), F.struct("user_id", "event_type", "value").alias("record"))
        sr.append_results(record, jsonl)
        scores = half.select(
            F.col("event_id").alias("index"), F.col("event_type").alias("model"),
            (F.col("event_id") % 2).cast("int").alias("EM"), F.round(F.col("value") / 10, 4).alias("F1"),
        )
        sr.append_scores(scores, csv)
    schema = "qid long, record struct<user_id:long,event_type:string,value:double>"
    back = sr.read_results(spark, jsonl, schema).select("qid", "record.user_id", "record.event_type", "record.value")
    scores = sr.read_scores(spark, csv).select(
        F.col("index").alias("qid"), "model", F.col("EM").alias("em"), F.col("F1").alias("f1")
    )
    return sr.round_scores(back.join(scores, "qid"))


@register("last_result", "SELECT user_id AS qid, max(event_id) AS run_seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_result(spark, sf):
    """The latest of several records per key."""
    runs = fx.table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("run_seq"), "event_type", "value")
    return sr.last_results(runs)


@register("resume_pending", "SELECT c_custkey AS qid, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def resume_pending(spark, sf):
    """Items that have no finished record yet."""
    todo = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), "c_name")
    done = fx.table(spark, sf, "events").where(F.col("event_type") == "purchase").select(F.col("user_id").alias("qid"))
    return sr.pending(todo, done)


@register("failure_split", """SELECT event_id AS qid, CASE WHEN event_id % 5 = 0 THEN NULL ELSE regexp_extract(props, '([0-9]+)', 1)::BIGINT END AS k,
    CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events""")
def failure_split(spark, sf):
    """Items whose record cannot be read are set apart, the others go on."""
    text = F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("}"), F.lit(" broken"))).otherwise(F.col("props"))
    parsed = json_value(text, "struct<k:long>")
    items = fx.table(spark, sf, "events").select(F.col("event_id").alias("qid"), parsed.alias("p")).select(
        "qid", F.col("p.k").alias("k"), F.when(F.col("p").isNull(), "unreadable").alias("error")
    )
    good, bad = sr.split_failures(items)
    return good.withColumn("status", F.lit("ok")).unionByName(bad.drop("error").withColumn("status", F.lit("failed")))


@register("stream_resume", """SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 0 ELSE 1 END AS run_seq, length(text) AS chars FROM benchmark""")
def stream_resume(spark, sf):
    """Two drops of question files, the second with everything again: every question is worked once."""
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    source, target, state = (scratch_path(spark, n) for n in ("arriving", "worked", "stream-state"))

    def work(batch):
        return batch.select("qid", F.length("text").alias("chars"))

    for drop in (items.where(F.col("qid") % 2 == 0), items.unionByName(items)):
        drop.write.mode("append").parquet(source)
        run_pending(spark, source, items.schema, work, target, state, key="qid").awaitTermination()
    return sr.read_results(spark, target, "qid long, chars int, run_seq int").select("qid", "run_seq", "chars")


# -- profiles ----------------------------------------------------------------------------------------------

@register("table_shape", f"""WITH {fx.CELLS_SQL}, n AS (SELECT table_id, col_ord, any_value(col_name) AS col_name, count(*) AS k FROM c GROUP BY ALL)
    SELECT table_id, max(k) AS "rows", count(*) AS cols, max(k) * count(*) AS cells, string_agg(col_name, ',' ORDER BY col_ord) AS names
    FROM n GROUP BY table_id""")
def table_shape(spark, sf):
    return pr.table_shape(fx.all_cells(spark, sf)).withColumn("names", F.array_join("names", ","))


@register("column_profile", f"""WITH {fx.CELLS_SQL} SELECT table_id, col_ord, col_name, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY ALL""")
def column_profile(spark, sf):
    return pr.value_counts(fx.all_cells(spark, sf))


EXAMPLES_SQL = f"""{fx.CELLS_SQL}, vc AS (SELECT table_id, col_ord, col_name, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY table_id, col_ord ORDER BY n DESC, value) AS place FROM vc),
    ex AS (SELECT table_id, col_ord, col_name, string_agg(value, ', ' ORDER BY place) AS examples FROM top WHERE place <= 5 GROUP BY ALL)"""


@register("column_examples", f"WITH {EXAMPLES_SQL} SELECT *, col_name || ' (Examples: ' || examples || ')' AS block FROM ex")
def column_examples(spark, sf):
    blocks = pr.column_blocks(fx.all_cells(spark, sf)).where(F.col("examples").isNotNull())
    return blocks.withColumn("examples", F.array_join("examples", ", "))


@register("column_descriptions", f"""WITH {EXAMPLES_SQL}, {fx.PART_QUESTIONS_SQL}
    SELECT pq.qid, ex.col_name, 'the ' || replace(ex.col_name, '_', ' ') || ': round 2  (Examples: ' || examples || ')' AS description,
           lower(replace(ex.col_name, '_', ' ')) || ' ' || lower('the ' || replace(ex.col_name, '_', ' ') || ': round 2  (Examples: ' || examples || ')') AS plain
    FROM pq JOIN ex USING (table_id)""")
def column_descriptions(spark, sf):
    """Description lines of a response, the last line of a column wins, with the column's examples."""
    asked = fx.part_questions(spark, sf).select("qid", "table_id")
    lines = F.array_join(
        F.flatten(
            F.array(*[
                F.array(F.lit(f"{c}: round 1"), F.lit(f" {c} : the {c.replace('_', ' ')}: round 2 "))
                for c in fx.PART_COLUMNS
            ])
        ),
        "\n",
    )
    responses = asked.select("qid", lines.alias("text"))
    samples = pr.column_examples(fx.part_cells(spark, sf)).select(
        "table_id", "col_name", pr.example_text(F.col("examples")).alias("sample")
    )
    found = rs.descriptions(responses, asked.join(samples, "table_id").select("qid", "col_name", "sample"))
    return found.select("qid", "col_name", "description", si.description_text(F.col("col_name"), F.col("description")).alias("plain"))


# -- votes ---------------------------------------------------------------------------------------------------

def event_votes(spark, sf):
    return rs.score_votes(fx.event_votes_text(spark, sf))


def event_filled(spark, sf):
    return vo.fill_votes(fx.event_columns(spark, sf), event_votes(spark, sf))


@register("score_lines", f"WITH {fx.EVENT_VOTES_SQL} SELECT * FROM votes")
def score_lines(spark, sf):
    return event_votes(spark, sf)


@register("score_fill", f"WITH {fx.EVENT_VOTES_SQL} SELECT * FROM filled")
def score_fill(spark, sf):
    return event_filled(spark, sf)


@register("vote_median_rank", f"""WITH {fx.EVENT_VOTES_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY qid, iteration ORDER BY score, col_ord)
    / (count(*) OVER (PARTITION BY qid, iteration))::DOUBLE AS norm_rank FROM filled)
    SELECT qid, col_ord, col_name, round(median(norm_rank), 6) AS median_rank FROM rk GROUP BY ALL""")
def vote_median_rank(spark, sf):
    return rounded(vo.median_rank(event_filled(spark, sf)))


RELIABLE_SQL = f"""{fx.EVENT_VOTES_SQL}, rel AS (SELECT qid, col_ord, col_name, avg(score) AS mean, stddev_pop(score) AS std FROM filled GROUP BY ALL)"""


@register("vote_reliability", f"""WITH {RELIABLE_SQL} SELECT qid, col_ord, col_name, round(mean, 6) AS mean, round(std, 6) AS std,
    round(1 / (1 + std), 6) AS reliability, round(mean / (1 + std), 6) AS adjusted FROM rel""")
def vote_reliability(spark, sf):
    return rounded(vo.reliable_scores(event_filled(spark, sf)))


@register("minmax_scale", f"""WITH {RELIABLE_SQL}, adj AS (SELECT qid, col_ord, col_name, mean / (1 + std) AS x FROM rel)
    SELECT qid, col_ord, col_name, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE x END, 6) AS adjusted
    FROM adj WINDOW w AS (PARTITION BY qid)""")
def minmax_scale(spark, sf):
    scores = vo.reliable_scores(event_filled(spark, sf)).select("qid", "col_ord", "col_name", "adjusted")
    return rounded(vo.min_max(scores, "adjusted"))


@register("column_similarity", f"WITH {fx.PART_QUESTIONS_SQL}, {fx.PART_CELLS_SQL}, {fx.PART_SIM_SQL} SELECT qid, col_ord, col_name, round(sim, 6) AS sim FROM psim")
def column_similarity(spark, sf):
    return rounded(si.column_similarity(fx.part_question_vectors(spark, sf), fx.part_column_vectors(spark, sf)))


DESCRIBED_SQL = f"""{fx.PART_QUESTIONS_SQL}, {fx.PART_CELLS_SQL}, {fx.PART_SIM_SQL},
    dc AS (SELECT DISTINCT table_id, col_ord, col_name FROM pc),
    q AS (SELECT qid, table_id AS corpus, question || ' by size and retailprice of its type' AS question FROM pq WHERE qid % 2 = 1),
    r AS (SELECT table_id AS corpus, col_ord AS row_id, replace(lower(col_name), '_', ' ') || ' ' || lower('The ' || replace(col_name, '_', ' ') || ' of a part') AS text FROM dc),
    {sql.row_scores(qv=None, rv=None)},
    ts AS (SELECT s.qid, s.row_id AS col_ord, dc.col_name, tfidf AS s FROM scored s JOIN dc ON dc.table_id = s.corpus AND dc.col_ord = s.row_id),
    tsim AS (SELECT qid, col_ord, col_name, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE s END AS sim
             FROM ts WINDOW w AS (PARTITION BY qid))"""


@register("column_similarity_text", f"""WITH {DESCRIBED_SQL} SELECT qid, col_ord, col_name, round(sim, 6) AS sim, 'text' AS basis FROM tsim
    UNION ALL SELECT qid, col_ord, col_name, round(sim, 6), 'vector' FROM psim WHERE qid % 2 = 0""")
def column_similarity_text(spark, sf):
    """Questions with vectors are compared by them, the others by the text of the descriptions."""
    asked = fx.part_questions(spark, sf)
    asked = asked.withColumn("question", F.concat("question", F.lit(" by size and retailprice of its type")))
    described = fx.part_cells(spark, sf).select("table_id", "col_ord", "col_name").distinct().withColumn(
        "description", F.concat(F.lit("The "), F.translate("col_name", "_", " "), F.lit(" of a part"))
    )
    vectors = fx.part_question_vectors(spark, sf).where(F.col("qid") % 2 == 0)
    return rounded(si.question_similarity(asked, described, vectors, fx.part_column_vectors(spark, sf), block_rows=BLOCK))


WORDS_SQL = "list_distinct(string_split(lower(question), ' '))"


@register("scorer_failures", f"""WITH {fx.PART_QUESTIONS_SQL}, {fx.PART_COLUMNS_SQL},
    s AS (SELECT qid, col_ord, col_name, len(list_intersect(list_distinct(string_split(lower(col_name), '_')), {WORDS_SQL}))::DOUBLE
                 / len(list_distinct(string_split(lower(col_name), '_'))) AS score FROM pcol JOIN pq USING (qid) WHERE qid % 7 <> 0)
    SELECT qid, col_ord, col_name, round(score, 6) AS score, 'ok' AS status, NULL AS error FROM s
    UNION ALL SELECT qid, NULL, NULL, NULL, 'failed', 'RuntimeError: no answer to ' || qid FROM pq WHERE qid % 7 = 0""")
def scorer_failures(spark, sf):
    """A scorer of one's own that fails for one question in seven; the others are scored."""

    def scorer(question, names):
        number, _, text = question.partition("\n")
        if int(number) % 7 == 0:
            raise RuntimeError(f"no answer to {number}")
        words = set(text.lower().split(" "))
        parts = [set(n.lower().split("_")) for n in names]
        return [len(p & words) / len(p) for p in parts]

    asked = fx.part_questions(spark, sf).select("qid", F.concat(F.col("qid").cast("string"), F.lit("\n"), "question").alias("question"))
    scored = pg.score_columns(asked, fx.part_columns(spark, sf).drop("table_id"), scorer)
    return rounded(scored.select("qid", "status", "error", F.inline_outer("columns")))


# -- clusters and their choice ---------------------------------------------------------------------------------

def order_clusters(spark, sf):
    return cl.cluster_columns(fx.order_scores(spark, sf))


CL_SQL = f"{fx.ORDER_SCORES_SQL}, {sql.kmeans()}"
CHOICE_SQL = f"{CL_SQL}, {fx.ORDER_QUESTIONS_SQL}, {sql.cluster_choice('oq')}"


@register("kmeans_batch", f"WITH {CL_SQL} SELECT qid, col_ord, col_name, cluster_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM cl")
def kmeans_batch(spark, sf):
    return rounded(order_clusters(spark, sf).drop("llm", "sim"))


@register("kmeans_wide", f"WITH {fx.SUPPLIER_SCORES_SQL}, {sql.kmeans('ss')} SELECT DISTINCT qid, cluster_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM cl")
def kmeans_wide(spark, sf):
    """Centres on wider tables."""
    return rounded(cl.centres(cl.cluster_columns(fx.supplier_scores(spark, sf))))


@register("kmeans_rounds", f"WITH {fx.CUSTOMER_SCORES_SQL}, {sql.kmeans('cu')} SELECT qid, col_ord, cluster_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM cl")
def kmeans_rounds(spark, sf):
    """Tables of a hundred columns, many of which take more than ten rounds."""
    return rounded(cl.cluster_columns(fx.customer_scores(spark, sf)).select("qid", "col_ord", "cluster_id", "cx", "cy"))


@register("kmeans_large", f"WITH {fx.POINT_SETS_SQL}, {sql.kmeans('big')} SELECT qid, col_ord, cluster_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM cl")
def kmeans_large(spark, sf):
    """All customers as one set of points and all parts as another, which stay rows through all rounds."""
    points = materialize(fx.point_sets(spark, sf), "points")
    return rounded(ps.cluster_points(points).select("qid", "col_ord", "cluster_id", "cx", "cy"))


@register("cluster_quality", f"""WITH {CHOICE_SQL} SELECT qid, cluster_id, round(cohesion, 6) AS cohesion, round(separation, 6) AS separation,
    round(quality, 6) AS quality FROM scores""")
def cluster_quality(spark, sf):
    quality = choose.cluster_quality(choose.cluster_profile(order_clusters(spark, sf)))
    return rounded(quality.select("qid", "cluster_id", "cohesion", "separation", "quality"))


@register("name_diversity", f"WITH {CHOICE_SQL} SELECT qid, cluster_id, size, round(diversity, 6) AS diversity FROM scores")
def name_diversity(spark, sf):
    profile = choose.cluster_profile(order_clusters(spark, sf))
    return rounded(profile.select("qid", "cluster_id", "size", choose.name_diversity().alias("diversity")))


@register("semantic_select", f"WITH {CHOICE_SQL} SELECT qid, semantic_choice AS choice, round(semantic_score, 6) AS score FROM vote")
def semantic_select(spark, sf):
    return rounded(choose.choose_semantic(choose.cluster_profile(order_clusters(spark, sf))))


@register("mcdm_select", f"WITH {CHOICE_SQL} SELECT qid, mcdm_choice AS choice, round(mcdm_score, 6) AS score FROM vote")
def mcdm_select(spark, sf):
    return rounded(choose.choose_mcdm(choose.cluster_profile(order_clusters(spark, sf)), fx.order_questions(spark, sf)))


@register("adaptive_select", f"WITH {CHOICE_SQL} SELECT qid, adaptive_choice AS choice, round(adaptive_score, 6) AS score, round(threshold, 6) AS threshold FROM vote")
def adaptive_select(spark, sf):
    return rounded(choose.choose_adaptive(choose.cluster_profile(order_clusters(spark, sf)), fx.order_questions(spark, sf)))


@register("cluster_vote", f"""WITH {CHOICE_SQL}, counted AS (SELECT qid, string_agg(cluster_id || ':' || ((cluster_id = semantic_choice)::INT + (cluster_id = mcdm_choice)::INT
        + (cluster_id = adaptive_choice)::INT), ',' ORDER BY cluster_id) AS votes FROM scores JOIN vote USING (qid) GROUP BY qid)
    SELECT qid, semantic_choice, mcdm_choice, adaptive_choice, round(semantic_score, 6) AS semantic_score, round(mcdm_score, 6) AS mcdm_score,
           round(adaptive_score, 6) AS adaptive_score, round(vote.threshold, 6) AS threshold, selected, votes FROM vote JOIN counted USING (qid)""")
def cluster_vote(spark, sf):
    vote = choose.choose_cluster(order_clusters(spark, sf), fx.order_questions(spark, sf))
    text = F.transform(F.map_entries("votes"), lambda e: F.concat_ws(":", e.key.cast("string"), e.value.cast("string")))
    return rounded(vote.withColumn("votes", F.array_join(text, ",")))


@register("column_selection", f"WITH {CHOICE_SQL}, {sql.selection()} SELECT * FROM sel")
def column_selection(spark, sf):
    return fl.filter_columns(fx.order_scores(spark, sf), fx.order_questions(spark, sf))


TOP_SQL = """lens AS (SELECT *, round(sqrt(llm * llm + sim * sim), 12) AS length FROM {points}),
    cut AS (SELECT qid, count(*) AS cols, quantile_cont(length, 0.6) AS cut FROM lens GROUP BY qid),
    placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY length DESC, col_ord) AS place FROM lens JOIN cut USING (qid)),
    kept AS (SELECT *, CASE WHEN cols >= 10 THEN col_ord ELSE place END AS o FROM placed
             WHERE CASE WHEN cols >= 10 THEN round(length, 12) >= round(cut, 12) ELSE place <= 3 END),
    tc AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY o) AS pos, col_ord, col_name, length FROM kept)"""
TOP_RESULT = "SELECT qid, pos, col_ord, col_name, round(length, 6) AS length FROM tc"


@register("ablation_topcols", f"WITH {fx.ORDER_SCORES_SQL}, {TOP_SQL.format(points='cs')} {TOP_RESULT}")
def ablation_topcols(spark, sf):
    """Columns by score length, narrow tables."""
    return rounded(co.top_norm_columns(fx.order_scores(spark, sf)))


@register("ablation_topcols_wide", f"WITH {fx.SUPPLIER_SCORES_SQL}, {TOP_SQL.format(points='ss')} {TOP_RESULT}")
def ablation_topcols_wide(spark, sf):
    """Columns by score length, tables of ten columns and more."""
    return rounded(co.top_norm_columns(fx.supplier_scores(spark, sf)))


@register("question_features", rf"""WITH t AS (SELECT 'c' || conv_id || '-' || turn AS qid, text AS question FROM conversations WHERE role = 'user'
      UNION ALL SELECT 'd' || doc_id, text FROM documents),
    cl AS (SELECT '' AS qid, 0 AS cluster_id, 0 AS col_ord, 0.0 AS llm, 0.0 AS sim, 0.0 AS cx, 0.0 AS cy, '' AS col_name),
    {sql.cluster_choice('t')} SELECT qid, round(complexity, 6) AS complexity, kind FROM qc""")
def question_features(spark, sf):
    turns = fx.table(spark, sf, "conversations").where(F.col("role") == "user").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"), F.col("text").alias("question")
    )
    docs = fx.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("qid"), F.col("text").alias("question")
    )
    text = F.col("question")
    return rounded(turns.unionByName(docs).select("qid", qf.complexity(text).alias("complexity"), qf.question_type(text).alias("kind")))


# -- rows -----------------------------------------------------------------------------------------------------------

def doc_inputs(spark, sf):
    return fx.doc_questions(spark, sf), fx.doc_rows(spark, sf), fx.question_vectors(spark, sf), fx.doc_vectors(spark, sf)


def doc_scores(spark, sf, signals=rw.SIGNALS):
    return rw.score_rows(*doc_inputs(spark, sf), block_rows=BLOCK, signals=signals)


RANKED_SQL = f"WITH {fx.DOC_SQL}, {sql.row_scores()}"


@register("row_text", f"WITH {fx.CELLS_SQL} SELECT table_id, row_id, string_agg(coalesce(value, 'None'), ' ' ORDER BY col_ord) AS text FROM c GROUP BY ALL")
def row_text(spark, sf):
    return fl.row_text(fx.all_cells(spark, sf), ["table_id", "row_id"], "col_ord")


@register("row_tfidf", f"{RANKED_SQL} SELECT qid, row_id, round(tfidf, 6) AS tfidf FROM scored")
def row_tfidf(spark, sf):
    return rounded(doc_scores(spark, sf, ("tfidf",)).select("qid", "row_id", "tfidf"))


@register("row_bm25", f"{RANKED_SQL} SELECT qid, row_id, round(bm25, 6) AS bm25 FROM scored")
def row_bm25(spark, sf):
    return rounded(doc_scores(spark, sf, ("bm25",)).select("qid", "row_id", "bm25"))


@register("row_dense", f"{RANKED_SQL} SELECT qid, row_id, round(dense, 6) AS dense FROM scored")
def row_dense(spark, sf):
    return rounded(doc_scores(spark, sf, ("dense",)).select("qid", "row_id", "dense"))


@register("row_softmax", f"{RANKED_SQL} SELECT qid, row_id, round(tfidf_p, 6) AS tfidf_p, round(bm25_p, 6) AS bm25_p, round(dense_p, 6) AS dense_p FROM soft")
def row_softmax(spark, sf):
    soft = rw.softmax(materialize(doc_scores(spark, sf)), ["tfidf", "bm25", "dense"])
    return rounded(soft.select("qid", "row_id", "tfidf_p", "bm25_p", "dense_p"))


@register("row_fusion", f"{RANKED_SQL} SELECT qid, row_id, round(fusion, 6) AS fusion FROM fused")
def row_fusion(spark, sf):
    return rounded(rw.fuse(materialize(doc_scores(spark, sf))).select("qid", "row_id", "fusion"))


@register("topk_rows", f"{RANKED_SQL} SELECT qid, row_id, round(fusion, 6) AS fusion, rnk FROM ranked WHERE {sql.KEEP}")
def topk_rows(spark, sf):
    best = rw.top_table_rows(*doc_inputs(spark, sf), block_rows=BLOCK)
    return rounded(best.select("qid", "row_id", "fusion", "rnk"))


EARLY_SQL = f"""WITH {fx.DOC_SQL},
    early AS (WITH q AS (SELECT item_id AS qid, 'src' || (item_id % {fx.SOURCES}) AS corpus, text AS question FROM benchmark WHERE item_id % 2 = 0),
              r AS (SELECT source AS corpus, doc_id AS row_id, text FROM documents WHERE doc_id % 3 <> 0), {sql.row_scores(qv=None, rv=None)} SELECT * FROM scored),
    late AS (WITH {sql.row_scores()} SELECT * FROM scored WHERE qid % 2 = 1)
    SELECT 'early' AS asked, qid, row_id, round(tfidf, 6) AS tfidf, round(bm25, 6) AS bm25, 0.0::DOUBLE AS dense FROM early
    UNION ALL SELECT 'late', qid, row_id, round(tfidf, 6), round(bm25, 6), round(dense, 6) FROM late"""


@register("index_reuse", EARLY_SQL)
def index_reuse(spark, sf):
    """A stored index asked by one question set, extended, and asked by another."""
    asked, rows, question_vectors, row_vectors = doc_inputs(spark, sf)
    index = ix.Index(spark, scratch_path(spark, "index"))
    ix.add_rows(index, rows.where(F.col("row_id") % 3 != 0))
    early = materialize(ix.score_index(index, asked.where(F.col("qid") % 2 == 0), block_rows=BLOCK))
    ix.add_rows(index, rows)
    late = ix.score_index(index, asked.where(F.col("qid") % 2 == 1), question_vectors, row_vectors, block_rows=BLOCK)
    both = early.withColumn("asked", F.lit("early")).unionByName(late.withColumn("asked", F.lit("late")))
    return rounded(both.select("asked", "qid", "row_id", "tfidf", "bm25", "dense"))


# -- text forms -------------------------------------------------------------------------------------------------------

def text_cells(spark, sf):
    return fx.all_cells(spark, sf).withColumnRenamed("col_ord", "pos")


PLACE_PART = f"(place // {PER_PART}) + 1"
PART_NO = f"(row_id // {PER_PART}) + 1"


def text_sql(cell: str, cell_break: str, between: str, after: str, header: bool) -> str:
    head = f" UNION ALL SELECT table_id, 0, string_agg(col_name, {cell_break} ORDER BY col_ord) || {after} FROM (SELECT DISTINCT table_id, col_ord, col_name FROM c) GROUP BY table_id"
    return f"""WITH {fx.CELLS_SQL}, lines AS (SELECT table_id, row_id, string_agg({cell}, {cell_break} ORDER BY col_ord) || {after} AS line FROM c GROUP BY ALL)
        SELECT table_id, {PART_NO} AS part, string_agg(line, {between} ORDER BY row_id) AS text FROM lines GROUP BY table_id, {PART_NO} {head if header else ''}"""


VALUE = "coalesce(value, 'None')"


@register("linearize_rows", text_sql(f"col_name || ': ' || {VALUE}", "'; '", "' | '", "''", False))
def linearize_rows(spark, sf):
    return ln.table_text(text_cells(spark, sf), ["table_id"], "row_id", ln.ROWS, PER_PART)


@register("linearize_header", text_sql(VALUE, "' | '", "chr(10)", "''", True) + " UNION ALL SELECT DISTINCT 'part-none', 0, '[No Table]' FROM lines")
def linearize_header(spark, sf):
    cells = text_cells(spark, sf)
    tables = cells.select("table_id").distinct()
    lost = fx.table(spark, sf, "region").select(F.concat(F.lit("part-none"), F.lit("")).alias("table_id")).distinct()
    text = ln.table_text(cells, ["table_id"], "row_id", ln.HEADER, PER_PART)
    return ln.or_no_table(text, cells, tables.unionByName(lost), ["table_id"])


@register("linearize_flat", text_sql(VALUE, "' | '", "''", "' '", True))
def linearize_flat(spark, sf):
    return ln.table_text(text_cells(spark, sf), ["table_id"], "row_id", ln.FLAT, PER_PART)


@register("linearize_tsv", text_sql(VALUE, "chr(9)", "''", "chr(10)", True))
def linearize_tsv(spark, sf):
    return ln.table_text(text_cells(spark, sf), ["table_id"], "row_id", ln.TSV, PER_PART)


def records_sql(source: str, keys: str, order: str, pos: str, part: str) -> str:
    return f"""(SELECT {keys}, {part} AS part, '[' || string_agg(line, ',' ORDER BY {order}) || ']' AS text FROM
        (SELECT {keys}, {order}, '{{' || string_agg('"' || col_name || '":' || coalesce('"' || value || '"', 'null'), ',' ORDER BY {pos}) || '}}' AS line
         FROM {source} GROUP BY ALL) GROUP BY ALL)"""


@register("records_pack", f"WITH {fx.CELLS_SQL} SELECT * FROM {records_sql('c', 'table_id', 'row_id', 'col_ord', PART_NO)}")
def records_pack(spark, sf):
    return ln.records(text_cells(spark, sf), ["table_id"], "row_id", PER_PART)


# -- responses and evaluation -------------------------------------------------------------------------------------------

@register("answer_lists", f"WITH {fx.ANSWERS_SQL} SELECT qid, method, array_to_string(answers, '|') AS answers, answer_type FROM ans")
def answer_lists(spark, sf):
    found = rs.answers(fx.answer_responses(spark, sf))
    return found.select("qid", "method", F.array_join("answers", "|").alias("answers"), "answer_type")


@register("answer_type", """SELECT event_id AS qid, CASE WHEN event_id % 4 = 0 THEN 'Other' WHEN event_id % 4 = 1 THEN 'number'
    WHEN value >= 100 THEN event_type ELSE 'person' END AS answer_type FROM events""")
def answer_type(spark, sf):
    kind, name = F.col("event_id") % 4, F.col("event_type")
    text = (
        F.when(kind == 0, F.concat(F.lit('["'), name, F.lit('"]')))
        .when(kind == 1, F.concat(F.lit('{"number": 0.9, "'), name, F.lit('": 0.9}')))
        .otherwise(F.concat(F.lit('{"person": 1.0, "'), name, F.lit('": '), F.when(F.col("value") >= 100, "1.5").otherwise("0.5"), F.lit("}")))
    )
    return rs.answer_types(fx.table(spark, sf, "events").select(F.col("event_id").alias("qid"), text.alias("text"))).select("qid", "answer_type")


@register("essential_columns", f"WITH {fx.PART_QUESTIONS_SQL}, {fx.PART_COLUMNS_SQL}, {fx.PART_ESSENTIAL_SQL} SELECT qid, ess_ord, col_name FROM pe")
def essential_columns(spark, sf):
    return rs.essential_columns(fx.part_essential(spark, sf), fx.part_columns(spark, sf).drop("table_id"))


EVAL_SQL = f"""{fx.ANSWERS_SQL}, {fx.GOLD_SQL},
    sets AS (SELECT a.qid, method, status, list_distinct(list_transform(a.answers, lambda x: trim(lower(x)))) AS p,
                    list_distinct(list_transform(g.answers, lambda x: trim(lower(x)))) AS g FROM ans a JOIN gold g USING (qid)),
    ef AS (SELECT qid, method, CASE WHEN status = 'ok' AND list_sort(p) = list_sort(g) THEN 1 ELSE 0 END AS em,
                  CASE WHEN status = 'ok' THEN 2.0 * len(list_intersect(p, g)) / (len(p) + len(g)) ELSE 0.0 END AS f1 FROM sets)"""


@register("eval_em_f1", f"WITH {EVAL_SQL} SELECT qid, method, em, round(f1, 6) AS f1 FROM ef")
def eval_em_f1(spark, sf):
    return rounded(pe.score_responses(fx.answer_responses(spark, sf), fx.gold_answers(spark, sf)))


@register("eval_summary", f"WITH {EVAL_SQL} SELECT method, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1 FROM ef GROUP BY method")
def eval_summary(spark, sf):
    return rounded(pe.evaluate_methods(fx.answer_responses(spark, sf), fx.gold_answers(spark, sf)))


# -- whole runs on the parts ----------------------------------------------------------------------------------------------

def part_scores(spark, sf):
    columns = fx.part_columns(spark, sf).drop("table_id")
    filled = vo.fill_votes(columns, rs.score_votes(fx.part_responses(spark, sf)))
    similar = si.column_similarity(fx.part_question_vectors(spark, sf), fx.part_column_vectors(spark, sf))
    return si.column_scores(columns, vo.reliable_scores(filled), similar)


def part_essential_columns(spark, sf):
    return rs.essential_columns(fx.part_essential(spark, sf), fx.part_columns(spark, sf).drop("table_id"))


def part_selected(spark, sf):
    return materialize(fl.filter_columns(part_scores(spark, sf), fx.part_questions(spark, sf), part_essential_columns(spark, sf)))


def part_best(spark, sf, selected):
    return fl.top_filtered_rows(
        fx.part_questions(spark, sf), fx.part_cells(spark, sf), selected,
        fx.part_question_vectors(spark, sf).drop("table_id"), fx.part_row_vectors(spark, sf), block_rows=BLOCK,
    )


def part_filtered(spark, sf):
    return fl.filter_tables(
        fx.part_questions(spark, sf), fx.part_cells(spark, sf), part_scores(spark, sf), part_essential_columns(spark, sf),
        fx.part_question_vectors(spark, sf).drop("table_id"), fx.part_row_vectors(spark, sf), block_rows=BLOCK,
    )


SELECTED_SQL = f"{fx.PART_ALL_SQL}, {sql.PART_SCORES}, {sql.kmeans()}, {sql.cluster_choice('pq')}, {sql.selection('pe')}"
FILTERED_SQL = f"""{SELECTED_SQL}, {sql.PART_FILTERED}, {sql.row_scores()},
    kc AS MATERIALIZED (SELECT k.qid, k.rnk, sel.pos, sel.col_name, pc.value FROM ranked k JOIN pq ON pq.qid = k.qid JOIN sel ON sel.qid = k.qid
       JOIN pc ON pc.table_id = pq.table_id AND pc.row_id = k.row_id AND pc.col_name = sel.col_name WHERE {sql.KEEP})"""


@register("project_selected", f"WITH {SELECTED_SQL} SELECT sel.qid, pq.table_id, pc.row_id, sel.pos, sel.col_name, pc.value FROM sel JOIN pq USING (qid) JOIN pc USING (table_id, col_name)")
def project_selected(spark, sf):
    wanted = part_selected(spark, sf).join(fx.part_questions(spark, sf).select("qid", "table_id"), "qid")
    return sc.project(fx.part_cells(spark, sf), wanted).select("qid", "table_id", "row_id", "pos", "col_name", "value")


@register("filter_table", f"WITH {FILTERED_SQL} SELECT * FROM kc")
def filter_table(spark, sf):
    return part_filtered(spark, sf)


@register("filter_text", f"""WITH {FILTERED_SQL}, lines AS (SELECT qid, rnk, string_agg(col_name || ': ' || {VALUE}, '; ' ORDER BY pos) AS line FROM kc GROUP BY ALL)
    SELECT qid, (rnk // {PER_PART}) + 1 AS part, string_agg(line, ' | ' ORDER BY rnk) AS text FROM lines GROUP BY ALL""")
def filter_text(spark, sf):
    """The reduced tables as text, the end of the whole run."""
    return ln.table_text(part_filtered(spark, sf), ["qid"], "rnk", ln.ROWS, PER_PART)


TEMPLATE = ("Given this table:\n", "\n\nAnswer from it: ", "\n\nIts columns mean:\n")


@register("context_text", f"""WITH {FILTERED_SQL}, tlines AS (SELECT qid, rnk, string_agg(col_name || ': ' || {VALUE}, '; ' ORDER BY pos) AS line FROM kc GROUP BY ALL),
    tparts AS (SELECT qid, (rnk // {PER_PART}) + 1 AS part, string_agg(line, ' | ' ORDER BY rnk) AS text FROM tlines GROUP BY ALL),
    dlist AS (SELECT qid, string_agg('- ' || col_name || ': about ' || col_name, chr(10) ORDER BY col_ord) AS listed FROM pcol GROUP BY qid)
    SELECT qid, 0 AS part, 'Given this table:' || chr(10) AS text FROM pq UNION ALL SELECT * FROM tparts
    UNION ALL SELECT qid, coalesce(max(tparts.part) + 1, 1), chr(10) || chr(10) || 'Answer from it: ' || any_value(question)
        || chr(10) || chr(10) || 'Its columns mean:' || chr(10) || any_value(listed)
    FROM pq JOIN dlist USING (qid) LEFT JOIN tparts USING (qid) GROUP BY qid""")
def context_text(spark, sf):
    """The reduced table of each question with the question and the descriptions around it."""
    asked = fx.part_questions(spark, sf)
    parts = materialize(ln.table_text(part_filtered(spark, sf), ["qid"], "rnk", ln.ROWS, PER_PART))
    described = fx.part_columns(spark, sf).select(
        "qid", F.col("col_ord").alias("pos"), "col_name", F.concat(F.lit("about "), "col_name").alias("description")
    )
    return ln.context_text(asked, parts, described, TEMPLATE)


TOKENS = f"len(list_filter(regexp_split_to_array(lower({VALUE}), '{sql.SPACE}'), lambda x: x <> ''))"


@register("reduction_stats", f"""WITH {FILTERED_SQL}, raw AS (SELECT table_id, count(*) AS raw_cells, sum({TOKENS})::BIGINT AS raw_tokens FROM pc GROUP BY table_id),
    small AS (SELECT qid, count(*) AS kept_cells, sum({TOKENS})::BIGINT AS kept_tokens FROM kc GROUP BY qid),
    z AS (SELECT qid, pq.table_id, coalesce(raw_cells, 0) AS raw_cells, coalesce(raw_tokens, 0) AS raw_tokens,
                 coalesce(kept_cells, 0) AS kept_cells, coalesce(kept_tokens, 0) AS kept_tokens
          FROM pq LEFT JOIN raw USING (table_id) LEFT JOIN small USING (qid))
    SELECT *, round(kept_cells / raw_cells, 6) AS cell_ratio, round(kept_tokens / raw_tokens, 6) AS token_ratio FROM z""")
def reduction_stats(spark, sf):
    return rounded(fl.reduction(fx.part_questions(spark, sf), fx.part_cells(spark, sf), part_filtered(spark, sf)))


@register("ablation_columns_only", f"WITH {SELECTED_SQL} SELECT sel.qid, pc.row_id, sel.pos, sel.col_name, pc.value FROM sel JOIN pq USING (qid) JOIN pc USING (table_id, col_name)")
def ablation_columns_only(spark, sf):
    return ab.columns_only(fx.part_questions(spark, sf), fx.part_cells(spark, sf), part_selected(spark, sf))


ROWS_ONLY_INPUT = """
q AS (SELECT qid, table_id AS corpus, question FROM pq),
r AS (SELECT table_id AS corpus, row_id, string_agg(coalesce(value, 'None'), ' ' ORDER BY col_ord) AS text FROM pc GROUP BY ALL),
qv AS (SELECT qid, v FROM pqv), rv AS (SELECT table_id AS corpus, row_id, v FROM prv)"""
ROWS_ONLY_SQL = f"{fx.PART_ALL_SQL}, {ROWS_ONLY_INPUT}, {sql.row_scores()}"


def part_rows_only(spark, sf):
    asked, cells = fx.part_questions(spark, sf), fx.part_cells(spark, sf)
    best = ab.top_all_columns(
        asked, cells, fx.part_question_vectors(spark, sf).drop("table_id"), fx.part_row_vectors(spark, sf), block_rows=BLOCK
    )
    return ab.rows_only(asked, cells, best)


@register("ablation_rows_only", f"""WITH {ROWS_ONLY_SQL} SELECT k.qid, k.rnk, pc.col_ord AS pos, pc.col_name, pc.value
    FROM ranked k JOIN pc ON pc.table_id = k.corpus AND pc.row_id = k.row_id WHERE {sql.KEEP}""")
def ablation_rows_only(spark, sf):
    return part_rows_only(spark, sf)


PACK_SQL = f"""WITH {FILTERED_SQL},
    ro AS (WITH {ROWS_ONLY_INPUT}, {sql.row_scores()} SELECT k.qid, k.rnk, pc.col_ord AS pos, pc.col_name, pc.value
           FROM ranked k JOIN pc ON pc.table_id = k.corpus AND pc.row_id = k.row_id WHERE {sql.KEEP}),
    oc AS (SELECT sel.qid, pc.row_id, sel.pos, sel.col_name, pc.value FROM sel JOIN pq USING (qid) JOIN pc USING (table_id, col_name)),
    tk AS (WITH {TOP_SQL.format(points='cs')} SELECT k.qid, k.rnk, tc.pos, tc.col_name, pc.value FROM ranked k JOIN pq ON pq.qid = k.qid
           JOIN tc ON tc.qid = k.qid JOIN pc ON pc.table_id = pq.table_id AND pc.row_id = k.row_id AND pc.col_name = tc.col_name WHERE {sql.KEEP}),
    ocp AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY row_id) - 1 AS place FROM oc),
    rop AS (SELECT *, rnk - 1 AS place FROM ro), tkp AS (SELECT *, rnk - 1 AS place FROM tk),
    a AS {records_sql('ocp', 'qid', 'place', 'pos', PLACE_PART)},
    b AS {records_sql('rop', 'qid', 'place', 'pos', PLACE_PART)},
    d AS {records_sql('tkp', 'qid', 'place', 'pos', PLACE_PART)},
    names AS (SELECT qid, string_agg(col_name, ',' ORDER BY pos) AS top_columns FROM (SELECT DISTINCT qid, pos, col_name FROM tk) GROUP BY qid)
    SELECT qid, part, a.text AS column_filtered, b.text AS row_filtered, d.text AS top_filtered, question, 'answer ' || qid AS answer, top_columns
    FROM a FULL JOIN b USING (qid, part) FULL JOIN d USING (qid, part) JOIN pq USING (qid) LEFT JOIN names USING (qid)"""


@register("ablation_pack", PACK_SQL)
def ablation_pack(spark, sf):
    """Three reduced tables side by side: columns only, rows only, columns by score length."""
    asked, cells = materialize(fx.part_questions(spark, sf)), materialize(fx.part_cells(spark, sf))
    scores = materialize(part_scores(spark, sf))
    selected = materialize(fl.filter_columns(scores, asked, part_essential_columns(spark, sf)))
    kept = materialize(part_best(spark, sf, selected))
    top = materialize(ab.top_columns(asked, cells, scores, kept))
    answered = asked.withColumn("answer", F.concat(F.lit("answer "), F.col("qid").cast("string")))
    packed = ab.side_by_side(
        answered, materialize(ab.columns_only(asked, cells, selected)), materialize(part_rows_only(spark, sf)), top, PER_PART
    )
    return packed.withColumn("top_columns", F.array_join("top_columns", ","))


# -- what a run knows of each question ------------------------------------------------------------------------------------

MIXED_SQL = f"""{fx.PART_ALL_SQL}, {sql.PART_SCORES},
    mq AS (SELECT qid, CASE WHEN qid % 7 = 0 THEN 'lost-' || qid ELSE table_id END AS table_id, question FROM pq),
    ms AS (SELECT * FROM cs WHERE qid % 5 <> 0 AND (qid % 3 <> 0 OR col_ord < 2))"""


def mixed_inputs(spark, sf):
    """Questions of which some ask a lost table, some have no scores and some have two columns."""
    asked = fx.part_questions(spark, sf)
    lost = F.concat(F.lit("lost-"), F.col("qid").cast("string"))
    asked = asked.withColumn("table_id", F.when(F.col("qid") % 7 == 0, lost).otherwise(F.col("table_id")))
    scores = part_scores(spark, sf).where((F.col("qid") % 5 != 0) & ((F.col("qid") % 3 != 0) | (F.col("col_ord") < 2)))
    return asked, scores


@register("question_status", f"""WITH {MIXED_SQL}, z AS (SELECT mq.qid, CASE WHEN mq.table_id NOT IN (SELECT table_id FROM pc) THEN 'no_table'
      WHEN k IS NULL THEN 'no_scores' WHEN k < 3 THEN 'few_points' ELSE 'ok' END AS reason
      FROM mq LEFT JOIN (SELECT qid, count(DISTINCT (round(llm, 12), round(sim, 12))) AS k FROM ms GROUP BY qid) USING (qid))
    SELECT qid, CASE WHEN reason IN ('ok', 'few_points') THEN 'ok' ELSE 'failed' END AS status, reason FROM z""")
def question_status(spark, sf):
    """Every question asked, with what became of it."""
    asked, scores = mixed_inputs(spark, sf)
    return pc.question_status(asked, fx.part_cells(spark, sf), scores)


@register("question_record", f"""WITH {MIXED_SQL}, {sql.kmeans('ms')}, {sql.cluster_choice('mq')}, {sql.selection('pe')},
    z AS (SELECT qid, string_agg(col_name || ':' || cluster_id, ',' ORDER BY col_ord) AS columns FROM cl GROUP BY qid),
    s AS (SELECT qid, string_agg(col_name, ',' ORDER BY pos) AS kept FROM sel GROUP BY qid)
    SELECT mq.qid, mq.table_id, CASE WHEN mq.table_id NOT IN (SELECT table_id FROM pc) THEN 'failed' WHEN z.qid IS NULL THEN 'failed' ELSE 'ok' END AS status,
           columns, selected, round(mcdm_score, 4) AS mcdm_score, kept, 'number' AS answer_type, 'number=0.9,person=0.1' AS type_scores
    FROM mq LEFT JOIN z USING (qid) LEFT JOIN vote USING (qid) LEFT JOIN s USING (qid)""")
def question_record(spark, sf):
    """Records of a whole run written as JSON lines and read back."""
    asked, scores = mixed_inputs(spark, sf)
    scores = materialize(scores)
    clusters = materialize(cl.cluster_columns(scores))
    vote = choose.choose_cluster(clusters, asked)
    selected = co.select_columns(clusters, vote, part_essential_columns(spark, sf))
    types = rs.answer_types(asked.select("qid", F.lit('{"number": 0.9, "person": 0.1}').alias("text"))).drop("text")
    status = pc.question_status(asked, fx.part_cells(spark, sf), scores)
    records = pc.question_records(asked, status, clusters, vote, selected, types)
    path = scratch_path(spark, "records")
    sr.append_results(records, path)
    back = sr.read_results(spark, path, records.schema)
    pairs = F.transform("columns", lambda c: F.concat_ws(":", c.col_name, c.cluster_id.cast("string")))
    scored = F.transform(F.map_entries("type_scores"), lambda e: F.concat_ws("=", e.key, e.value.cast("string")))
    return sr.round_scores(
        back.select(
            "qid", "table_id", "status", F.array_join(pairs, ",").alias("columns"), "vote.selected", "vote.mcdm_score",
            F.array_join("kept", ",").alias("kept"), "answer_type", F.array_join(scored, ",").alias("type_scores"),
        )
    )


@register("run_resumed", f"""WITH {FILTERED_SQL}, rlines AS (SELECT qid, rnk, string_agg(col_name || ': ' || {VALUE}, '; ' ORDER BY pos) AS line FROM kc GROUP BY ALL),
    rparts AS (SELECT qid, (rnk // {PER_PART}) + 1 AS part, string_agg(line, ' | ' ORDER BY rnk) AS text FROM rlines GROUP BY ALL),
    rbest AS (SELECT k.qid, count(*) AS kept_rows, max(round(fusion, 6)) AS top_score FROM ranked k WHERE {sql.KEEP} GROUP BY k.qid),
    rcols AS (SELECT qid, string_agg(col_name || '=' || description, ',' ORDER BY pos) AS columns FROM
             (SELECT qid, pos, col_name, 'about ' || col_name AS description FROM sel) GROUP BY qid),
    rvotes AS (SELECT qid, count(*) AS votes FROM pv GROUP BY qid)
    SELECT qid, CASE WHEN qid % 2 = 0 THEN 1 ELSE 2 END AS run, 'ok' AS status, part, text, kept_rows, top_score, columns, votes
    FROM rparts JOIN rbest USING (qid) JOIN rcols USING (qid) JOIN rvotes USING (qid) WHERE qid % 7 <> 0
    UNION ALL SELECT qid, CASE WHEN qid % 2 = 0 THEN 1 ELSE 2 END, 'failed', NULL, NULL, NULL, NULL, NULL, NULL FROM pq WHERE qid % 7 = 0""")
def run_resumed(spark, sf):
    """A run over half of the questions, one over all that takes up the rest, and everything known of them read back."""
    asked = fx.part_questions(spark, sf)
    lost = F.concat(F.lit("lost-"), F.col("qid").cast("string"))
    asked = materialize(asked.withColumn("table_id", F.when(F.col("qid") % 7 == 0, lost).otherwise(F.col("table_id"))))
    inputs = {
        "cells": materialize(fx.part_cells(spark, sf)), "scores": materialize(part_scores(spark, sf)), "votes": rs.score_votes(fx.part_responses(spark, sf)),
        "types": rs.answer_types(asked.select("qid", F.lit('{"number": 0.9}').alias("text"))).drop("text"),
        "essential": part_essential_columns(spark, sf),
        "descriptions": fx.part_columns(spark, sf).select("qid", "col_name", F.concat(F.lit("about "), "col_name").alias("description")),
        "question_vectors": fx.part_question_vectors(spark, sf).drop("table_id"), "row_vectors": fx.part_row_vectors(spark, sf),
    }
    path = scratch_path(spark, "run")
    runs.run_questions(spark, path, asked.where(F.col("qid") % 2 == 0), **inputs, rows_per_part=PER_PART, block_rows=BLOCK)
    second = runs.run_questions(spark, path, asked, **inputs, rows_per_part=PER_PART, block_rows=BLOCK)
    rows = runs.read_part(spark, path, "rows").groupBy("qid").agg(F.count("*").alias("kept_rows"), F.max(F.round("fusion", 6)).alias("top_score"))
    named = F.transform(F.sort_array(F.collect_list(F.struct("pos", "col_name", "description"))), lambda c: F.concat_ws("=", c.col_name, c.description))
    columns = runs.read_part(spark, path, "columns").where(F.col("pos").isNotNull()).groupBy("qid").agg(F.array_join(named, ",").alias("columns"))
    votes = runs.read_part(spark, path, "votes").groupBy("qid").agg(F.count("*").alias("votes"))
    out = runs.read_text(spark, path).withColumn("run", F.when(F.col("run") == second, 2).otherwise(1))
    for part in (rows, columns, votes):
        out = out.join(part, "qid", "left")
    return rounded(out.select("qid", "run", "status", "part", "text", "kept_rows", "top_score", "columns", "votes"))
