"""Row scoring: TF-IDF, BM25 and dense similarity of every row with the questions of its corpus.

A *corpus* is the set of rows one question is asked against: a table, or a table cut down to
the columns chosen for a question. Inputs:

* ``rows(corpus, row_id, text)``, row_id unique in its corpus, or the postings of such rows;
* ``questions(qid, corpus, question)``.

Layout. Texts are tokenised once: their terms are counted per row and written down as postings
``(corpus, row_id, kind, term, tf, len)``, with one mark per row. Document frequencies are aggregates of the postings,
combined before the shuffle. A row's length under TF-IDF depends on the row and its corpus alone and is summed
once. For the products with questions, rows fall into blocks by a hash of their id, as many as their number asks for, and
questions into groups; a term asked in a group is laid out once per block and a posting once per group. So neither a
table with most of the rows, nor a table with most of the questions, nor a word that all of them share meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tablesieve.functions import text as tx, vectors as vx
from tablesieve.operators.selection import positions, select_best
from tablesieve.runtime import materialize

BLOCK_ROWS = 10_000
GROUP_QUESTIONS = 256

#: Bytes of text that a task counts: the counts of its terms take about a hundred times as much memory.
TASK_TEXT = 4_000_000
#: Bytes of text below which another task gains nothing.
LEAST_TEXT = 64_000

# Parameters of the scores.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_FLOOR = 0.25
WEIGHTS = {"tfidf": 0.4, "bm25": 0.3, "dense": 0.3}
KEEP_RATIO = 0.4

WORD, PIECE, MARK = "w", "p", "m"
SIGNALS = tuple(WEIGHTS)


def places(count: Column, size: int) -> Column:
    """How many places of about ``size`` members ``count`` of them need."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(size))).cast("long")


def place_of(member: Column, count: Column) -> Column:
    """Place of a member, whatever the spacing of ids."""
    return F.pmod(F.xxhash64(member), count)


def text_tasks(texts: DataFrame, text: str) -> int:
    """In how many tasks texts are counted, by their bytes: as many as there are cores while texts are few.

    Exchanges that are left to adaptive execution grow to its size of a partition, which is meant for rows as they are read
    and is far too much for text whose terms are held apart.
    """
    (size,) = texts.agg(F.sum(F.octet_length(text))).first()
    return tasks_of(texts.sparkSession, size)


def tasks_of(spark: SparkSession, size: int | None) -> int:
    """In how many tasks ``size`` bytes of text are counted."""
    size = size or 0
    return max(1, -(-size // TASK_TEXT), min(spark.sparkContext.defaultParallelism, size // LEAST_TEXT))


def lowered(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Each text in lower case, missing ones empty, and its words where it has characters beyond ``text.PLAIN``: ``keys..., text, words``."""
    listed = texts.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    words = F.regexp_extract_all("text", F.lit(tx.WORD), 0)
    return listed.select(*keys, "text", F.when(F.col("text").rlike(f"[^{tx.PLAIN}]"), words).alias("words"))


def tokens(texts: DataFrame, keys: list[str], text: str, kinds: tuple[str, ...] = (WORD, PIECE)) -> DataFrame:
    """All tokens of each text, ``keys..., len, kind, term``, and one mark per text; ``len`` counts its pieces."""
    body = F.col(text)
    none = F.array().cast("array<string>")
    words = F.coalesce(tx.word_tokens(body), none) if WORD in kinds else none
    pieces = F.coalesce(F.split(F.lower(body), tx.SPACE), none) if PIECE in kinds else none
    # told apart by position: no expression runs once per token before they are rows
    # a split at runs of white space has empty pieces at its ends only
    ends = F.get("_p", F.lit(0)).eqNullSafe("").cast("int") + F.get("_p", F.size("_p") - 1).eqNullSafe("").cast("int")
    listed = texts.select(*keys, words.alias("_w"), pieces.alias("_p")).select(
        *keys, F.greatest(F.lit(0), F.size("_p") - ends).cast("long").alias("len"),
        F.size("_w").alias("_words"), (F.size("_w") + F.size("_p")).alias("_all"),
        F.posexplode(F.concat("_w", "_p", F.array(F.lit("")))).alias("_pos", "term"),
    )
    kind = F.when(F.col("_pos") < F.col("_words"), WORD).when(F.col("_pos") < F.col("_all"), PIECE).otherwise(MARK)
    return listed.select(*keys, "len", kind.alias("kind"), "term").where((F.col("kind") != PIECE) | (F.col("term") != ""))


def with_length(counted: DataFrame) -> DataFrame:
    """Adds ``len``, the white-space pieces of a row, to counted terms placed by row that come from several texts."""
    one_row = W.partitionBy("corpus", "row_id")
    return counted.withColumn("len", F.sum(F.when(F.col("kind") == PIECE, F.col("tf")).otherwise(0)).over(one_row))


def postings(rows: DataFrame, kinds: tuple[str, ...] = (WORD, PIECE)) -> DataFrame:
    """Counted terms of rows(corpus, row_id, text): ``corpus, row_id, kind, term, tf, len``.

    The text is shuffled once, by row; counting and lengths stay where the row is. ``rows`` is read twice, at first for
    the bytes of its texts: their number of tasks grows with them, so a task holds the terms of ``TASK_TEXT`` bytes.
    """
    texts = rows.select("corpus", "row_id", "text")
    placed = texts.repartition(text_tasks(texts, "text"), "corpus", "row_id")
    counted = tokens(placed, ["corpus", "row_id"], "text", kinds).groupBy("corpus", "row_id", "kind", "term", "len")
    return counted.agg(F.count("*").alias("tf"))


@dataclass
class Statistics:
    """What a corpus knows of its rows and terms, read from written tables."""

    terms: DataFrame    # corpus, kind, term, df
    corpora: DataFrame  # corpus, n, avg_len, mean_idf, blocks


def corpus_statistics(terms: DataFrame, sizes: DataFrame, block_rows: int = BLOCK_ROWS) -> Statistics:
    """From written terms(corpus, kind, term, df) and sizes(corpus, n, len); the sizes are written down here."""
    # the vocabulary is reduced to "how many terms have this df" before it meets the corpus size
    spectrum = terms.where(F.col("kind") == PIECE).groupBy("corpus", "df").agg(F.count("*").alias("terms"))
    return Statistics(terms, corpora_of(spectrum, sizes, block_rows))


def corpora_of(spectrum: DataFrame, sizes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What ``Statistics`` has of corpora, written down, from spectrum(corpus, df, terms) of white-space pieces and sizes(corpus, n, len)."""
    idf = spectrum.join(sizes, "corpus").select("corpus", "terms", bm25_idf(F.col("n"), F.col("df")).alias("idf"))
    mean_idf = idf.groupBy("corpus").agg((F.sum(F.col("terms") * F.col("idf")) / F.sum("terms")).alias("mean_idf"))
    corpora = sizes.join(mean_idf, "corpus", "left").select(
        "corpus", "n", (F.col("len") / F.col("n")).alias("avg_len"),
        F.coalesce("mean_idf", F.lit(0.0)).alias("mean_idf"), places(F.col("n"), block_rows).alias("blocks"),
    )
    return materialize(corpora, "corpora")


def statistics(counted: DataFrame, block_rows: int = BLOCK_ROWS) -> Statistics:
    """Document frequencies and sizes of all corpora of written postings."""
    is_mark = F.col("kind") == MARK
    terms = materialize(counted.where(~is_mark).groupBy("corpus", "kind", "term").agg(F.count("*").alias("df")), "terms")
    sizes = counted.where(is_mark).groupBy("corpus").agg(F.count("*").alias("n"), F.sum("len").alias("len"))
    return corpus_statistics(terms, sizes, block_rows)


def tfidf_idf(n: Column, df: Column) -> Column:
    """Smoothed idf over ``n`` texts."""
    return F.log((n + 1) / (df + 1)) + 1


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def question_terms(stats: Statistics, questions: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Terms of each question with their weights in its corpus, and a mark per question, written down.

    The question counts as one more text for TF-IDF, so ``n`` and ``df`` grow by one there;
    BM25 knows the rows only and a negative idf becomes a quarter of the mean idf.
    """
    key = ["corpus", "kind", "term"]
    listed = tokens(questions, ["qid", "corpus"], "question", kinds).groupBy("qid", *key).agg(F.count("*").alias("qtf"))
    many = questions.groupBy("corpus").agg(places(F.count("*"), GROUP_QUESTIONS).alias("groups"))
    asked = listed.join(stats.corpora.join(many, "corpus"), "corpus")
    # each term is looked up once, however many questions ask for it
    known = stats.terms.join(listed.select(key).distinct(), key)
    asked = asked.join(known, key, "left").withColumn("df", F.coalesce("df", F.lit(0)))
    n, df = F.col("n"), F.col("df")
    raw = bm25_idf(n, df)
    weighted = asked.select(
        "qid", "corpus", "kind", "term", "qtf", "df", "n", "avg_len", "blocks", "groups",
        place_of(F.col("qid"), F.col("groups")).alias("group"),
        tfidf_idf(n + 1, df + 1).alias("idf"),
        tfidf_idf(n + 1, df).alias("idf_rows"),
        F.when(raw < 0, F.col("mean_idf") * BM25_FLOOR).otherwise(raw).alias("idf_bm25"),
    )
    return materialize(weighted, "asked")


def row_lengths(counted: DataFrame, stats: Statistics) -> DataFrame:
    """Every row with its squared length under TF-IDF, from the rows alone: ``corpus, row_id, alone``.

    A frequent word has one line on the side of the terms, so its postings can be split between tasks.
    """
    idf = stats.terms.where(F.col("kind") == WORD).join(stats.corpora.select("corpus", "n"), "corpus").select(
        "corpus", "term", tfidf_idf(F.col("n") + 1, F.col("df")).alias("idf")
    )
    words = counted.where(F.col("kind") == WORD).join(idf, ["corpus", "term"])
    return words.groupBy("corpus", "row_id").agg(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("alone"))


def products(counted: DataFrame, stats: Statistics, asked: DataFrame) -> DataFrame:
    """Sums over common terms: ``corpus, row_id, qid, product, square, bm25``.

    ``square`` is the correction the question makes to the squared length of the row.
    """
    terms = asked.where((F.col("kind") != MARK) & (F.col("df") > 0))
    laid_out = terms.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    split = asked.select("corpus", "blocks", "groups").distinct()
    spread = counted.where(F.col("kind") != MARK).join(split, "corpus").select(
        "corpus", "row_id", "kind", "term", "tf", "len",
        place_of(F.col("row_id"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"),
    )
    pairs = spread.join(laid_out.drop("blocks", "groups", "n"), ["corpus", "block", "group", "kind", "term"])
    tf, is_word = F.col("tf"), F.col("kind") == WORD
    saturation = tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg_len"))
    return pairs.groupBy("corpus", "row_id", "qid").agg(
        F.sum(F.when(is_word, F.col("qtf") * tf * F.pow("idf", 2)).otherwise(0.0)).alias("product"),
        F.sum(F.when(is_word, tf * tf * (F.pow("idf", 2) - F.pow("idf_rows", 2))).otherwise(0.0)).alias("square"),
        F.sum(
            F.when(~is_word, F.col("qtf") * F.col("idf_bm25") * tf * (BM25_K1 + 1) / saturation).otherwise(0.0)
        ).alias("bm25"),
    )


def score_postings(
    questions: DataFrame,
    counted: DataFrame,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    kinds: tuple[str, ...] = (WORD, PIECE),
) -> DataFrame:
    """Scores from written postings, as ``score_rows``."""
    stats = statistics(counted, block_rows)
    asked = question_terms(stats, questions, kinds)
    rows = counted.where(F.col("kind") == MARK).select("corpus", "row_id")
    if WORD in kinds:
        rows = rows.join(row_lengths(counted, stats), ["corpus", "row_id"], "left")
    else:
        rows = rows.withColumn("alone", F.lit(0.0))
    return pair_scores(asked, rows, counted, stats, question_vectors, row_vectors, kinds)


def pair_scores(
    asked: DataFrame,
    rows: DataFrame,
    counted: DataFrame,
    stats: Statistics,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    kinds: tuple[str, ...] = (WORD, PIECE),
) -> DataFrame:
    """Scores of all pairs, as ``score_rows``, from the questions' written terms, rows(corpus, row_id, alone) and postings."""
    lengths = asked.where(F.col("kind") == WORD).groupBy("qid").agg(
        F.sum(F.pow(F.col("qtf") * F.col("idf"), 2)).alias("q_square")
    )
    heads = asked.where(F.col("kind") == MARK).select("qid", "corpus", "n", "blocks", "groups", "group")
    heads = heads.join(lengths, "qid", "left")
    dense = F.lit(0.0)
    if question_vectors is not None and row_vectors is not None:
        heads = heads.join(
            question_vectors.select("qid", F.col("vector").alias("q_vector"), vx.norm(F.col("vector")).alias("q_norm")),
            "qid", "left",
        )
        rows = rows.join(
            row_vectors.select(
                "corpus", "row_id", F.col("vector").alias("r_vector"), vx.norm(F.col("vector")).alias("r_norm")
            ),
            ["corpus", "row_id"], "left",
        )
        dense = vx.cosine(vx.dot(F.col("q_vector"), F.col("r_vector")), F.col("q_norm"), F.col("r_norm"))
    split = asked.select("corpus", "blocks", "groups").distinct()
    rows = rows.join(split, "corpus").withColumn("block", place_of(F.col("row_id"), F.col("blocks")))
    rows = rows.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("blocks", "groups")
    heads = heads.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "groups")
    # the vectors end here: what is shuffled per pair is a number
    pairs = rows.join(heads, ["corpus", "block", "group"]).select(
        "corpus", "block", "row_id", "qid", "n", "alone", "q_square", F.coalesce(dense, F.lit(0.0)).alias("dense")
    )
    zero = F.lit(0.0)
    none = {c: F.coalesce(c, zero) for c in ("product", "square", "bm25", "alone", "q_square")}
    q_length = F.sqrt(none["q_square"])
    r_length = F.sqrt(F.greatest(none["alone"] + none["square"], zero))
    if not kinds:
        return pairs.select("corpus", "block", "row_id", "qid", "n", zero.alias("tfidf"), zero.alias("bm25"), "dense")
    return pairs.join(products(counted, stats, asked), ["corpus", "row_id", "qid"], "left").select(
        "corpus", "block", "row_id", "qid", "n",
        vx.cosine(none["product"], q_length, r_length).alias("tfidf"), none["bm25"].alias("bm25"), "dense",
    )


def score_rows(
    questions: DataFrame,
    rows: DataFrame,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    signals: tuple[str, ...] = SIGNALS,
) -> DataFrame:
    """Scores of every row for every question of its corpus.

    ``question_vectors(qid, vector)`` and ``row_vectors(corpus, row_id, vector)`` are optional; without them, or where
    one is missing, the dense score is 0. Of ``signals``, those not asked for are 0 and cost nothing.
    Out: ``corpus, block, row_id, qid, n, tfidf, bm25, dense``.
    """
    kinds = tuple(k for k, s in ((WORD, "tfidf"), (PIECE, "bm25")) if s in signals)
    if "dense" not in signals:
        question_vectors = row_vectors = None
    counted = materialize(postings(rows, kinds), "postings")
    return score_postings(questions, counted, question_vectors, row_vectors, block_rows, kinds)


# Scores are summed by the stretch of this width that they lie in, so that no power of e leaves the range of a double.
STRETCH = 16


def softmax_totals(scores: DataFrame, columns: list[str]) -> DataFrame:
    """``qid, <score>_top, <score>_sum``: greatest score, and the sum of e^(score - greatest), from one pass.

    A sum is kept per stretch of scores, relative to where the stretch begins. Such sums can be added up in any order and
    before any shuffle, and no greatest score need be known for it; a question has as many of them as its scores have
    stretches. Where it is known, the sums are scaled to it.
    """
    stretch = {c: F.floor(F.col(c) / F.lit(STRETCH)).alias(f"_{c}") for c in columns}
    start = {c: F.col(f"_{c}").cast("double") * F.lit(STRETCH) for c in columns}
    placed = scores.select("qid", *columns, *stretch.values())
    parts = placed.groupBy("qid", *[f"_{c}" for c in columns]).agg(
        *[F.max(c).alias(f"{c}_top") for c in columns], *[F.sum(F.exp(F.col(c) - start[c])).alias(f"{c}_part") for c in columns]
    )
    question = W.partitionBy("qid")
    topped = parts.select(
        "qid", *[f"_{c}" for c in columns], *[f"{c}_part" for c in columns], *[F.max(f"{c}_top").over(question).alias(f"{c}_top") for c in columns]
    )
    return topped.groupBy("qid").agg(
        *[F.max(f"{c}_top").alias(f"{c}_top") for c in columns],
        *[F.sum(F.col(f"{c}_part") * F.exp(start[c] - F.col(f"{c}_top"))).alias(f"{c}_sum") for c in columns],
    )


def softmax(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Softmax of each score over all rows of a question, as ``<score>_p``.

    Greatest scores and sums come from one pass and are written down, one row per question; a second pass divides. ``scores``
    is read twice: pass a materialised frame.
    """
    totals = materialize(softmax_totals(scores, columns), "totals")
    parts = [(F.exp(F.col(c) - F.col(f"{c}_top")) / F.col(f"{c}_sum")).alias(f"{c}_p") for c in columns]
    return scores.join(totals, "qid").select(*scores.columns, *parts)


def fuse(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of the softmaxed scores as ``fusion``. ``scores`` should be materialised."""
    weights = WEIGHTS if weights is None else weights
    parts = softmax(scores, list(weights))
    total = None
    for name, weight in weights.items():
        term = F.col(f"{name}_p") * F.lit(float(weight))
        total = term if total is None else total + term
    return parts.withColumn("fusion", total)


SIGNIFICANT = 12


def significant(value: Column, digits: int = SIGNIFICANT) -> Column:
    """``value`` to a number of significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, value).otherwise(F.round(value * scale) / scale)


SORT_KEYS = ("sort_key", "tfidf_key", "bm25_key", "dense_key")


def with_sort_keys(fused: DataFrame) -> DataFrame:
    """Adds what rows are ranked by, greatest first, before the row id.

    Fusion is compared to the digits a double carries, relative to its size, so that the order of summation cannot
    decide between equal rows and no row that matches is lost among those that do not. Then the scores
    themselves decide, to 9 decimals in the order of their weights, and then the larger row id.
    """
    keyed = fused.withColumn("sort_key", significant(F.col("fusion")))
    for c in ("tfidf", "bm25", "dense"):
        keyed = keyed.withColumn(f"{c}_key", F.round(c, 9) if c in fused.columns else F.lit(0.0))
    return keyed


def rank_rows(fused: DataFrame) -> DataFrame:
    """Add ``rnk``, the place of each row within its question, best first."""
    order = [F.desc(c) for c in (*SORT_KEYS, "row_id")]
    ranked = positions(with_sort_keys(fused), "qid", *order)
    return ranked.withColumn("rnk", F.col("place") + 1).drop("place", *SORT_KEYS)


def kept_count(n: Column, ratio: float) -> Column:
    """How many of ``n`` rows are kept: the ratio, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(float(ratio))))


def keep_top(ranked: DataFrame, ratio: float = KEEP_RATIO) -> DataFrame:
    """The best ``ratio`` of each question's ranked rows."""
    return ranked.where(F.col("rnk") <= kept_count(F.col("n"), ratio))


def rank_scores(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Fuse and rank all scores: ``qid, row_id, tfidf, bm25, dense, fusion, n, rnk``."""
    ranked = rank_rows(fuse(materialize(scores, "scores"), weights))
    return ranked.select("qid", "row_id", "tfidf", "bm25", "dense", "fusion", "n", "rnk")


def top_scores(scores: DataFrame, weights: dict[str, float] | None = None, ratio: float = KEEP_RATIO) -> DataFrame:
    """Fuse scores and rank the best ``ratio`` of each question's rows; the others are never sorted.

    Out as ``rank_scores``, and the same rows and ranks as ``keep_top`` of it.
    """
    keyed = with_sort_keys(fuse(materialize(scores, "scores"), weights))
    best = select_best(keyed, "qid", [*SORT_KEYS, "row_id"], lambda size: kept_count(size, ratio))
    return best.select("qid", "row_id", "tfidf", "bm25", "dense", "fusion", "n", (F.col("place") + 1).alias("rnk"))


def top_table_rows(
    questions: DataFrame,
    rows: DataFrame,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    ratio: float = KEEP_RATIO,
) -> DataFrame:
    """Score and fuse all rows, and rank the best ``ratio``, as ``top_scores``."""
    return top_scores(score_rows(questions, rows, question_vectors, row_vectors, block_rows), weights, ratio)


def rank_table_rows(
    questions: DataFrame,
    rows: DataFrame,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Score, fuse and rank all rows: ``qid, row_id, tfidf, bm25, dense, fusion, n, rnk``."""
    return rank_scores(score_rows(questions, rows, question_vectors, row_vectors, block_rows), weights)
