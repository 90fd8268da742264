"""Best-fit packing of token sequences of bounded length, in bulk.

Best fit sees nothing of a document but its length, and nothing of an open sequence but its gap. Documents are
sorted by length and ranked within it; sequences are numbered as they are opened. Equal documents, and equal
gaps, then travel as runs (size, first rank or sequence, count): at most one run per length and a few
gap runs per length, however many documents there are. Each superstep sweeps from a length, the longest first, to
the successor gap, lets the documents take the gaps of that run in order of rank, as many per gap as fit, and puts the
narrowed gaps back. The outcome is that of the sequential best-fit-decreasing rule. The sweeps see runs only and
leave a table of placements; every task then finds the placement of each of its documents by its length and rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesieve.llm import arrow
from tablesieve.llm.encoding import encoder
from tablesieve.llm.ranking import bucket_count, numbered
from tablesieve.runtime import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PIECES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("ids", pa.binary())]
)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only what is too long is cut, and the first piece may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int, with_ids: bool):
    encode = encoder(path)
    last = np.array([end], "<u4").tobytes()
    for rows in batches:
        out = []
        for key, ids in zip(rows.column(0).to_pylist(), encode.ids(rows.column(1).to_pylist()), strict=True):
            whole = memoryview(ids + last)
            for number, (start, length) in enumerate(cuts(len(whole) // 4, capacity)):
                part = whole[4 * start : 4 * (start + length)]
                out.append((key, number, start, length, zlib.crc32(part), bytes(part) if with_ids else None))
        yield arrow.batch(PIECES_ARROW, [list(c) for c in zip(*out, strict=True)] or [[]] * len(PIECES_ARROW))


def token_pieces(
    docs: DataFrame, path: str, end: int, capacity: int, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of every whole text's ids, closed by ``end``: ``doc_id, piece, start, length, ids_crc32, ids``.

    ``ids`` (little-endian unsigned 32-bit) is filled on demand. A missing text is empty and has its end id alone.
    """
    arrow.prepared(docs.sparkSession)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(lambda it: piece_batches(it, path, end, capacity, with_ids), PIECES)


@dataclass
class Placements:
    """For each length, in order of rank: first rank, first sequence, documents per sequence, offset of the first."""

    by_length: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    sequences: int = 0

    def arrays(self) -> dict[int, np.ndarray]:
        return {length: np.array(rows, np.int64) for length, rows in self.by_length.items()}


class Gaps:
    """Open sequences as runs (first sequence, count) by gap, with the gaps in use kept sorted."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def put(self, size: int, first: int, count: int) -> None:
        if not size or not count:
            return
        if size not in self.runs:
            self.runs[size] = []
            bisect.insort(self.sizes, size)
        self.runs[size].append((first, count))

    def successor(self, length: int) -> tuple[int, int, int] | None:
        """Takes a run of the smallest gap that holds ``length``: (gap, first sequence, count)."""
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        size = self.sizes[at]
        first, count = self.runs[size].pop()
        if not self.runs[size]:
            del self.runs[size]
            del self.sizes[at]
        return size, first, count


def sweep(counts: dict[int, int], capacity: int) -> Placements:
    """Best fit of ``counts`` documents of each length, the longest lengths first."""
    placed, gaps = Placements(), Gaps()
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            found = gaps.successor(length)
            if found is None:
                # as many new sequences as the rest of this length fills
                fresh = -(-left // (capacity // length))
                found = capacity, placed.sequences, fresh
                placed.sequences += fresh
            gap, first, count = found
            each = gap // length
            filled = min(count, left // each)
            if not filled:
                each, filled = left, 1
            placed.by_length[length].append((rank, first, each, capacity - gap))
            gaps.put(gap - each * length, first, filled)
            gaps.put(gap, first + filled, count - filled)
            rank += each * filled
            left -= each * filled
    return placed


def place_batches(batches: Iterator[pa.RecordBatch], placements, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = placements.value
    for rows in batches:
        length, place = rows.column("length").to_numpy(), rows.column("place").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            runs = table[int(size)]
            run = runs[np.searchsorted(runs[:, 0], place[at], side="right") - 1]
            step = place[at] - run[:, 0]
            sequence[at] = run[:, 1] + step // run[:, 2]
            offset[at] = run[:, 3] + step % run[:, 2] * size
        kept = [rows.column(n) for n in schema.names[:-2]]
        yield arrow.batch(schema, [*kept, sequence, offset])


def pack(items: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``items``, which have a ``length`` from 1 to ``capacity``.

    ``order`` names integer columns that tell the rows apart; rows equal in all of them are interchangeable. The
    rows are written down, ranked within their length without gathering a length in one task, and placed. What
    goes to the tasks is the placements: their number depends on ``capacity``, not on the number of rows.
    """
    spark = arrow.prepared(items.sparkSession)
    columns = [*dict.fromkeys([*order, "length"])]
    rows = materialize(items.select(*columns), "pack-items")
    # no more rows than there are lengths
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    # a length has buckets by its own number of rows, so that there are few of them beside the rows
    buckets = spark.createDataFrame([(k, bucket_count(n)) for k, n in counts.items()], "length long, buckets long")
    drawn = rows.join(F.broadcast(buckets), "length")
    drawn = drawn.withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets"))).select(*columns, "bucket")
    ranked = numbered(drawn, ["length"], "bucket", order).select(*columns, "place")
    placements = spark.sparkContext.broadcast(sweep(counts, capacity).arrays())
    added = [("sequence_id", pa.int64()), ("offset", pa.int64())]
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[k]) for n, k in ranked.dtypes if n != "place"] + added)
    names = ", ".join(f"{n} {k}" for n, k in ranked.dtypes if n != "place") + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(lambda it: place_batches(it, placements, schema), names)


def pack_documents(docs: DataFrame, path: str, end: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents in as few sequences of ``capacity`` tokens as best fit needs, one row per piece.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; each sequence is filled from offset 0 without gaps. A
    missing or empty text is its end id; missing keys and repeated rows are packed like any other; documents of
    any length are cut into pieces; an empty table gives an empty one. Other columns are not read.
    """
    pieces = token_pieces(docs, path, end, capacity, key, text).drop("ids")
    return pack(pieces, capacity, ["doc_id", "piece", "start", "ids_crc32"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed token ids: ``sequence_id, ids``, from the result of ``pack_documents`` and pieces with ids.

    A sequence is bounded by the capacity, so gathering its pieces is too. Keys must be unique.
    """
    parts = packed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda out, p: F.concat(out, p.ids))
    return parts.groupBy("sequence_id").agg(joined.alias("ids"))
