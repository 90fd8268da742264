"""Audit of how the sources of a language differ in their terms.

Identical texts of a language are collapsed first: one text stays, with the number of its copies in every source. Each
text that is left is tokenised once; its terms count as often as it has copies, per source, and so do the documents that
have a term. A language keeps the terms found in at least ``LEAST_DOCUMENTS`` of its documents. Shares are whole
billionths with a small count added to every kept term, so all arithmetic is exact.

Distances between sources are summed block by block of terms: a task holds the counts that its terms do have, lays out a
slice of them at a time, and gives one number per pair of sources that has a result anyway. Copies are added up where
they are read, before they are shuffled; a hot source or language is so many blocks of terms.

Defined cases: a null text, language or source is the empty string; a text without terms leaves its group without
counts; a language without kept terms has distances of 0 and no terms; an empty table gives no rows. Other columns are
not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tablesieve.runtime import materialize

# A term's bytes in UTF-8 (letters A to Z and a to z, and all beyond ASCII), and the smoothed share.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LEAST_DOCUMENTS = 30
SCALE = 1_000_000_000
ADDED = 5
REPORTED_TERMS = 50

#: A worker hands on its counts when it holds so many.
HELD_TERMS = 500_000
#: Counts per block of terms, and cells of a slice that is laid out.
BLOCK_COUNTS = 200_000
SLICE_CELLS = 1 << 21

COUNTS = "lang string, source string, term string, count long, docs long"
COUNTS_ARROW = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())]
)
PAIRS = "lang string, a int, b int, value long"
PAIRS_ARROW = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])


def collapsed(docs: DataFrame) -> DataFrame:
    """Distinct texts of each language with their copies per source: ``lang, text, sources``.

    A text travels once per task that has it; the copies are counted by the text's digest. Both sides are laid out by
    (lang, digest), so they meet without another shuffle.
    """
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    named = named.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = named.groupBy("lang", "digest", "source").agg(F.count("*").alias("copies"))
    shares = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "copies")).alias("sources"))
    texts = named.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(shares, ["lang", "digest"]).select("lang", "text", "sources")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, text, sources), added up as long as a worker can hold them."""
    lower = bytes(range(256)).lower()
    held: dict[tuple, list] = {}
    size = 0

    def handed_on() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (counts, found) in held.items():
            n = len(counts)
            for column, values in zip(columns, ([lang] * n, [source] * n, counts, counts.values(), map(found.get, counts)), strict=True):
                column.extend(values)
        columns[2] = pa.array(columns[2], pa.binary()).cast(pa.string())
        held.clear()
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, COUNTS_ARROW, strict=True)],
            schema=COUNTS_ARROW,
        )

    for rows in batches:
        texts = rows.column(1).cast(pa.binary())
        for lang, text, sources in zip(rows.column(0).to_pylist(), texts, rows.column(2).to_pylist(), strict=True):
            terms = Counter(TERM.findall(text.as_buffer().to_pybytes().translate(lower)))
            for share in sources:
                counts, found = held.setdefault((lang, share["source"]), ({}, {}))
                before, copies = len(counts), share["copies"]
                for term, n in terms.items():
                    counts[term] = counts.get(term, 0) + n * copies
                    found[term] = found.get(term, 0) + copies
                size += len(counts) - before
            if size > HELD_TERMS:
                yield handed_on()
                size = 0
    yield handed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs`` of every term of every group, written down."""
    found = collapsed(docs).mapInArrow(counted, COUNTS)
    return materialize(found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "term-counts")


def share_of(count: str, total: str, terms: str) -> str:
    """SQL of a smoothed share in whole billionths."""
    wide = f"cast({count} + {ADDED} as decimal(20, 0)) * cast({SCALE} as decimal(11, 0))"
    return f"1 + {wide} div cast({total} + {ADDED} * {terms} as decimal(22, 0))"


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value``: the distance of every two groups of a language, by their numbers.

    ``kept(lang, term, no, share)`` has the terms that a group has; ``groups(lang, no, size, entries, base)`` one row per
    group with the share ``base`` of a term it has not.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("entries") / F.lit(BLOCK_COUNTS))).cast("long")
    spread = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select("lang", "block", "no", "base")
    dealt = kept.join(groups.select("lang", blocks.alias("blocks")).distinct(), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "no", "share"
    )

    def summed(key: tuple[pa.Scalar, ...], table: pa.Table, members: pa.Table) -> pa.Table:
        members = members.sort_by("no")
        base = members.column("base").to_numpy()
        size, total = len(base), np.zeros((len(base), len(base)), np.int64)
        terms = table.column("term").combine_chunks().dictionary_encode()
        place, shares = terms.indices.to_numpy(), table.column("share").to_numpy()
        number = table.column("no").to_numpy()
        order = np.argsort(place, kind="stable")
        place, shares, number = place[order], shares[order], number[order]
        width = max(1, SLICE_CELLS // max(1, size))
        for start in range(0, len(terms.dictionary), width):
            low, high = np.searchsorted(place, [start, start + width])
            cells = np.repeat(base[:, None], min(width, len(terms.dictionary) - start), axis=1)
            cells[number[low:high], place[low:high] - start] = shares[low:high]
            for a in range(size - 1):
                total[a, a + 1 :] += np.abs(cells[a + 1 :] - cells[a]).sum(axis=1)
        a, b = np.triu_indices(size, 1)
        return pa.table([[key[0].as_py()] * len(a), a.astype(np.int32), b.astype(np.int32), total[a, b]], schema=PAIRS_ARROW)

    sums = dealt.groupBy("lang", "block").cogroup(spread.groupBy("lang", "block")).applyInArrow(summed, PAIRS)
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark a source.

    ``lang, source, part, item, value, rank``: part ``pair`` has every other source, part ``term`` at most
    ``REPORTED_TERMS`` terms whose share in the source is above that in the language.
    """
    counts = term_counts(docs)
    by_term = counts.groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs"))
    vocabulary = materialize(by_term.where(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term", "all"), "vocabulary")
    languages = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("all_total"))

    kept = materialize(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "count", "all"), "kept-counts")
    # every group that occurs, with or without terms
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("held"))
    of_lang = W.partitionBy("lang")
    groups = named.join(totals, ["lang", "source"], "left").join(languages, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "all_total")],
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("no"),
        F.coalesce(F.sum("held").over(of_lang), F.lit(0)).alias("entries"),
    )
    base = F.when(F.col("terms") > 0, F.expr(share_of("0", "total", "terms"))).otherwise(0)
    groups = materialize(groups.withColumn("base", base), "groups")

    shares = materialize(
        kept.join(groups, ["lang", "source"]).select(
            "lang", "source", "no", "term",
            F.expr(share_of("count", "total", "terms")).alias("share"), F.expr(share_of("`all`", "all_total", "terms")).alias("usual"),
        ),
        "shares",
    )
    sums = pair_sums(shares, groups)
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one = groups.select("lang", F.col("no").alias("a"), "source")
    other = groups.select("lang", F.col("no").alias("b"), F.col("source").alias("item"))
    pairs = both.join(one, ["lang", "a"]).join(other, ["lang", "b"]).select("lang", "source", "item", "value")
    marks = shares.where(F.col("share") > F.col("usual")).select(
        "lang", "source", F.col("term").alias("item"), (F.col("share") - F.col("usual")).alias("value")
    )
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", place).unionByName(
        # only the first places are asked for, so each task hands on no more than those
        marks.withColumn("rank", place).where(F.col("rank") <= REPORTED_TERMS).withColumn("part", F.lit("term"))
    )
    return ranked.select("lang", "source", "part", "item", "value", "rank")
