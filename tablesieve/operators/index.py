"""A stored inverted index of row texts: tokenised once, read by any number of question sets, extended in place.

Layout of an index folder::

    segments/                      one row per addition: its name and settings; an addition counts once it is listed here
    postings/segment=/kind=/block= corpus, page, page_rows: posting lists of terms (``pages``); block is a hash of (corpus, term), sorted by corpus
    rows/segment=                  corpus, row_id, len: every row, also one without terms

Document frequencies, row counts and lengths of an index are sums over its pages and segments, so an addition is written beside
what is there and nothing is built anew. Rows that the index already has are left out of an addition, so one that was
broken off can be repeated. Questions read the postings of their own terms: the blocks of those terms are directories, and within
a file the sort order lets the reader skip what other corpora have. No text is stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablesieve.operators import pages as pg, rows as rw
from tablesieve.operators.pages import block_of
from tablesieve.runtime import materialize

BLOCKS = 64
SLICE_ROWS = 10_000_000

#: Most corpora that are named in a filter; more are joined.
NAMED_CORPORA = 1000

SEGMENTS = "segment string, blocks int, rows long"
STORED = "corpus string, page binary, page_rows binary, segment string, kind string, block int"
ROWS = "corpus string, row_id {row_id}, len long, segment string"


@dataclass
class Index:
    spark: SparkSession
    path: str
    row_id: str = "long"

    def segments(self) -> DataFrame:
        return self.spark.read.schema(SEGMENTS).parquet(f"{self.path}/segments")

    def _names(self) -> list[str]:
        """One name per addition."""
        return [r.segment for r in self.segments().select("segment").collect()]

    def _table(self, name: str, schema: str) -> DataFrame:
        found = self.spark.read.schema(schema.format(row_id=self.row_id)).parquet(f"{self.path}/{name}")
        return found.where(F.col("segment").isin(self._names()))

    def functions(self, blocks: int = BLOCKS) -> SimpleNamespace:
        return pg.functions(to_arrow_type(T.DataType.fromDDL(self.row_id)), blocks, (rw.PIECE, rw.WORD, rw.MARK))

    def opened(self, pages: DataFrame) -> DataFrame:
        """Lists of postings of pages(corpus, kind, page, page_rows), of the ``wanted`` terms if there is such a column: ``corpus, kind, term, df, row_ids, counts``."""
        names = [c for c in ("corpus", "kind", "page", "page_rows", "wanted") if c in pages.columns]
        schema = f"corpus string, kind string, term string, df int, row_ids array<{self.row_id}>, counts array<long>"
        return pages.select(names).mapInArrow(self.functions().opened, schema)

    def pages(self) -> DataFrame:
        return self._table("postings", STORED).where(F.col("kind") != rw.MARK)

    def postings(self) -> DataFrame:
        return taken_apart(self.opened(self.pages()), "corpus", "kind", "term")

    def rows(self) -> DataFrame:
        return self._table("rows", ROWS)

    def terms(self) -> DataFrame:
        """Document frequencies of the whole index: ``corpus, kind, term, df``."""
        found = self.pages().select("corpus", "kind", "page").mapInArrow(self.functions().frequencies, "corpus string, kind string, term string, df int")
        return found.groupBy("corpus", "kind", "term").agg(F.sum("df").alias("df"))


def taken_apart(lists: DataFrame, *keys: str) -> DataFrame:
    """One line per posting of a list: ``keys, row_id, tf, len``."""
    apart = lists.select(*keys, "counts", F.posexplode("row_ids").alias("_at", "row_id"))
    count = F.get("counts", F.col("_at"))
    return apart.select(*keys, "row_id", F.shiftright(count, 32).alias("tf"), count.bitwiseAND(F.lit(0xFFFFFFFF)).alias("len"))


def counted_pages(index: Index, rows: DataFrame, tasks: int, blocks: int) -> DataFrame:
    """Pages of rows(corpus, row_id, text), with the postings and marks of ``rows.postings``: ``corpus, kind, block, page, page_rows``.

    Rows of a corpus are counted side by side, so that a task has few corpora and long lists; a large corpus is dealt to many tasks.
    """
    placed = rows.repartitionByRange(tasks, F.col("corpus"), F.xxhash64("row_id")).sortWithinPartitions("corpus", "row_id")
    return rw.lowered(placed, ["corpus", "row_id"], "text").mapInArrow(index.functions(blocks).counted, pg.PAGES)


def add_rows(index: Index, rows: DataFrame, blocks: int = BLOCKS) -> int:
    """Adds rows(corpus, row_id, text) that the index does not have yet, and returns how many.

    ``row_id`` is unique within its corpus. An index that does not exist is begun. All additions of an index have the same
    number of blocks.
    """
    new = rows.select("corpus", "row_id", "text")
    if exists(index):
        (known,) = [r.blocks for r in index.segments().select("blocks").distinct().collect()]
        if known != blocks:
            raise ValueError(f"the index has {known} blocks, not {blocks}")
        new = new.join(index.rows().select("corpus", "row_id"), ["corpus", "row_id"], "left_anti")
    size, lines = new.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    segment = uuid.uuid4().hex
    path = f"{index.path}/postings/segment={segment}"
    write_pages(counted_pages(index, new, rw.tasks_of(index.spark, size), blocks), path, lines)
    written = index.spark.read.schema("corpus string, page binary, page_rows binary, kind string, block int").parquet(path)
    marks = taken_apart(index.opened(written.where(F.col("kind") == rw.MARK)), "corpus").select("corpus", "row_id", "len")
    added = f"{index.path}/rows/segment={segment}"
    marks.write.parquet(added)
    count = index.spark.read.schema(marks.schema).parquet(added).count()
    listed = index.spark.createDataFrame([(segment, blocks, count)], SEGMENTS)
    listed.coalesce(1).write.mode("append").parquet(f"{index.path}/segments")
    return count


def write_pages(pages: DataFrame, path: str, rows: int) -> None:
    """A block is a directory per kind, and a file of it holds the pages of a slice in the order that lets readers skip.

    A term that every row has is in one block, so blocks are sliced by page, as many times as the number of rows asks for.
    """
    slices = -(-max(1, rows) // SLICE_ROWS)
    placed = pages.repartition("kind", "block", F.pmod(F.xxhash64("page"), F.lit(slices)) if slices > 1 else F.lit(0))
    # pages are compressed
    ordered = placed.sortWithinPartitions("kind", "block", "corpus")
    ordered.write.option("compression", "none").partitionBy("kind", "block").parquet(path)


def exists(index: Index) -> bool:
    """Whether anything was added to the index."""
    from pyspark.errors import AnalysisException

    try:
        return not index.spark.read.schema(SEGMENTS).parquet(f"{index.path}/segments").isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def compact(index: Index, path: str, blocks: int = BLOCKS) -> Index:
    """The index as one segment in another folder; its questions read fewer files."""
    out = Index(index.spark, path, index.row_id)
    segment = uuid.uuid4().hex
    index.rows().drop("segment").write.parquet(f"{path}/rows/segment={segment}")
    (total,) = index.rows().agg(F.count("*")).first()
    # lists of a block side by side, so that its pages are few
    lists = index.opened(index.pages()).repartition("kind", block_of(blocks)).sortWithinPartitions("corpus", "kind", "term")
    write_pages(lists.mapInArrow(index.functions(blocks).repaged, pg.PAGES), f"{path}/postings/segment={segment}", total)
    index.spark.createDataFrame([(segment, blocks, total)], SEGMENTS).coalesce(1).write.parquet(f"{path}/segments")
    return out


def of_corpora(corpora: DataFrame | None) -> Callable[[DataFrame], DataFrame]:
    """Function that keeps what belongs to distinct ``corpora``; None stands for all. A few are named, so that readers can skip others."""
    if corpora is None:
        return lambda frame: frame
    names = [r.corpus for r in corpora.limit(NAMED_CORPORA + 1).collect()]
    if len(names) > NAMED_CORPORA:
        return lambda frame: frame.join(corpora, "corpus", "left_semi")
    return lambda frame: frame.where(F.col("corpus").isin(names))


def statistics(index: Index, block_rows: int = rw.BLOCK_ROWS) -> rw.Statistics:
    """What the index knows of its corpora, from the sums of its segments."""
    return rw.corpus_statistics(materialize(index.terms(), "terms"), corpus_sizes(index.rows()), block_rows)


def corpus_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("corpus").agg(F.count("*").alias("n"), F.sum("len").alias("len"))


def lists_of(index: Index, wanted: DataFrame) -> DataFrame:
    """Lists of distinct terms(corpus, kind, term), of which questions ask a few; blocks without any are not read."""
    blocks = [r.blocks for r in index.segments().select("blocks").distinct().collect()][0]
    key = ["corpus", "kind", "block"]
    wanted = materialize(wanted.withColumn("block", block_of(blocks)).groupBy(key).agg(F.collect_list("term").alias("wanted")), "asked-terms")
    # at most as many as there are blocks
    named = [r.block for r in wanted.select("block").distinct().collect()]
    return index.opened(index.pages().where(F.col("block").isin(named)).join(wanted, key))


def asked_postings(index: Index, asked: DataFrame) -> DataFrame:
    """Postings of the terms that written questions ask for; blocks without any are not read."""
    wanted = asked.where((F.col("kind") != rw.MARK) & (F.col("df") > 0)).select("corpus", "kind", "term").distinct()
    return taken_apart(lists_of(index, wanted), "corpus", "kind", "term").select("corpus", "row_id", "kind", "term", "tf", "len")


def by_block(pages: DataFrame, kind: str, corpora: DataFrame) -> DataFrame:
    """Pages of a kind where those of a block of a corpus are side by side, with the corpus's number of rows: ``corpus, n, block, page, page_rows``."""
    of_kind = pages.where(F.col("kind") == kind).join(F.broadcast(corpora.select("corpus", "n")), "corpus")
    used = ["page", "page_rows"] if kind == rw.WORD else ["page"]
    return of_kind.select("corpus", "n", "block", *used).repartition("corpus", "block").sortWithinPartitions("corpus", "block")


def spectrum(index: Index, pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """How many white-space pieces of a corpus have a document frequency: ``corpus, df, terms``."""
    parts = by_block(pages, rw.PIECE, sizes).mapInArrow(index.functions().spectrum, "corpus string, df long, terms long")
    return parts.groupBy("corpus", "df").agg(F.sum("terms").alias("terms"))


def row_lengths(index: Index, pages: DataFrame, corpora: DataFrame) -> DataFrame:
    """Every row that has words with its squared length under TF-IDF, as ``rows.row_lengths``: ``corpus, row_id, alone``."""
    parts = by_block(pages, rw.WORD, corpora).mapInArrow(index.functions().squares, f"corpus string, row_id {index.row_id}, alone double")
    return parts.groupBy("corpus", "row_id").agg(F.sum("alone").alias("alone"))


def score_index(
    index: Index,
    questions: DataFrame,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    block_rows: int = rw.BLOCK_ROWS,
    stats: rw.Statistics | None = None,
) -> DataFrame:
    """Scores of every row for questions(qid, corpus, question), as ``rows.score_rows`` of all rows added so far.

    Lengths under TF-IDF depend on the document frequencies and are summed from the word lists of the corpora asked;
    ``stats`` of an index that has not grown can be handed on from one question set to the next.
    """
    kinds = (rw.WORD, rw.PIECE)
    corpora = questions.select("corpus").distinct()
    only, key = of_corpora(corpora), ["corpus", "kind", "term"]
    listed = rw.tokens(questions, ["qid", "corpus"], "question", kinds).where(F.col("kind") != rw.MARK).select(key).distinct()
    lists = materialize(lists_of(index, listed).select(*key, "df", "row_ids", "counts"), "asked-lists")
    pages = only(index.pages())
    if stats is None:
        # the vocabulary is counted for its mean idf, which knows white-space pieces alone; nothing else of it is shuffled
        sizes = materialize(corpus_sizes(only(index.rows())), "sizes")
        corpora_known = rw.corpora_of(spectrum(index, pages, sizes), sizes, block_rows)
        stats = rw.Statistics(lists.groupBy(key).agg(F.sum("df").alias("df")), corpora_known)
    asked = rw.question_terms(stats, questions, kinds)
    rows = only(index.rows().select("corpus", "row_id"))
    rows = rows.join(row_lengths(index, pages, stats.corpora), ["corpus", "row_id"], "left")
    return rw.pair_scores(asked, rows, taken_apart(lists, *key), stats, question_vectors, row_vectors, kinds)
