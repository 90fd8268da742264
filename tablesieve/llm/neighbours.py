"""Nearest neighbours by inner product: stable random projections, a kd-tree over them, and a chi-square stopping test.

Vectors get one more component that gives all of them the same length, so the largest inner product is the smallest
distance. A few Gaussian projections are 2-stable: the squared projected distance over the squared distance has
the chi-square distribution with as many degrees of freedom as there are projections. The projected vectors are indexed by a
kd-tree with small cells. A query takes the cells step by step in the order of their projected distance, and verifies their rows
on the original vectors. After each step the test is made: once the next cell is so far that a vector nearer than the
k-th found would lie there with probability at most ``1 - confidence``, the search of that query ends. Steps grow by a
factor, so a query verifies at most about that factor more than it needs.

The tree is built on a bounded sample, every vector is indexed. Neighbouring cells are stored in bundles of bounded size; a
cell that holds more rows than a bundle is cut by a hash, as copies of one vector cannot be told apart by any split.
Queries travel to the bundles, once for each bundle that a step takes cells of; vectors are not copied. A bundle's vectors are
held by one task, the queries that visit it stream past.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tablesieve.llm import arrow
from tablesieve.runtime import materialize

SEED = 29
PROJECTIONS = 8
CONFIDENCE = 0.95

#: The tree: about so many vectors it is built on (chosen by a hash of their ids), most cells, rows that a cell should have.
SAMPLE_ROWS = 100_000
MOST_CELLS = 16_384
CELL_ROWS = 32
#: Rows of a bundle.
BUNDLE_ROWS = 8192
#: Rows that the first step should verify for each neighbour wanted, and how much further each step goes.
FIRST_ROWS, GROWTH = 4, 8
#: Query and cell, or query and row, pairs that are held at once.
HELD_PAIRS = 1 << 21

INDEXED = "vec_id long, cell int, vector binary, place array<double>"
INDEXED_ARROW = pa.schema(
    [("vec_id", pa.int64()), ("cell", pa.int32()), ("vector", pa.binary()), ("place", pa.list_(pa.float64()))]
)
PLACED = "bundle long, kind int, id long, vector binary, least double, cell int, cells array<int>, rows long"
VISIT_ARROW = pa.schema(
    [("bundle", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("vector", pa.binary()), ("least", pa.float64()),
     ("cell", pa.int32()), ("cells", pa.list_(pa.int32())), ("rows", pa.int64())]
)
FOUND = "query_id long, vec_id long, score double"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def chi_square_quantile(p: float, degrees: int) -> float:
    """Value below which a chi-square number with an even number of degrees lies with probability ``p``."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1.0 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


@dataclass
class Projection:
    """Gaussian projection of vectors lengthened to the same length."""

    directions: np.ndarray  # (dimension + 1, PROJECTIONS)
    square: float  # largest squared length of an indexed vector

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0.0))
        return x @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.directions[:-1]


@dataclass
class Tree:
    """Splits of a kd-tree as a heap: node i splits by axis[i] at value[i]; leaves are the cells."""

    depth: int
    axis: np.ndarray
    value: np.ndarray

    def cells(self, places: np.ndarray) -> np.ndarray:
        node = np.zeros(len(places), np.int64)
        rows = np.arange(len(places))
        for _ in range(self.depth):
            node = 2 * node + 1 + (places[rows, self.axis[node]] > self.value[node])
        return node - (2**self.depth - 1)


def build_tree(places: np.ndarray, cells: int) -> Tree:
    """Median splits along the widest axis of each node."""
    depth = max(0, math.ceil(math.log2(max(1, cells))))
    axis, value = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    parts = {0: places}
    for node in range(2**depth - 1):
        rows = parts.pop(node)
        if len(rows):
            axis[node] = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            value[node] = float(np.median(rows[:, axis[node]]))
        right = rows[:, axis[node]] > value[node]
        parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]
    return Tree(depth, axis, value)


@dataclass
class Cells:
    """The cells that have rows: boxes around their projected rows, their sizes, and the bundles they are stored in."""

    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    bundle: np.ndarray  # first bundle of the cell
    blocks: np.ndarray  # bundles it is cut into

    def distances(self, places: np.ndarray) -> np.ndarray:
        """Squared projected distance of each query to each box."""
        out = np.zeros((len(places), len(self.number)))
        for j in range(self.low.shape[1]):
            beside = np.maximum(self.low[None, :, j] - places[:, j, None], places[:, j, None] - self.high[None, :, j])
            out += np.maximum(beside, 0.0) ** 2
        return out


def bundles(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bundle and number of bundles of each cell: neighbouring small cells share one, a large cell has several."""
    first, blocks = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    number, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > BUNDLE_ROWS:
            number, held = number + 1, 0
        first[i] = number
        held += int(n)
        if n > BUNDLE_ROWS:
            blocks[i] = -(-n // BUNDLE_ROWS)
            number, held = number + blocks[i], 0
    return first, blocks


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    """Vectors of a column of little-endian doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dimension)


def valid_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part: with an id, and a finite vector that is not zero."""
    column = vectors[vector].cast("array<double>")
    whole = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), column.alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(column, lambda v: v != 0))


def index_batches(batches: Iterator[pa.RecordBatch], projection: Projection, tree: Tree) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if not rows.num_rows:
            continue
        x = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        places = projection.rows(x)
        packed = [v.tobytes() for v in np.ascontiguousarray(x, "<f8")]
        yield arrow.batch(INDEXED_ARROW, [rows.column(0), tree.cells(places), packed, list(places)])


def visit_batches(batches, dimension: int, projection: Projection, cells: Cells, step: tuple[int, int], limit: float):
    """The bundles each query visits in a step, with the cells it takes there.

    A step goes from the cell at which ``step[0]`` rows are reached to that at which ``step[1]`` are, in order of projected
    distance, as far as the stopping test does not hold.
    """
    for rows in batches:
        width = max(1, HELD_PAIRS // max(1, len(cells.number)))
        for start in range(0, rows.num_rows, width):
            part = rows.slice(start, width)
            q = matrix(part.column("vector"), dimension)
            distance = cells.distances(projection.queries(q))
            order = np.argsort(distance, axis=1, kind="stable")
            before = np.cumsum(cells.size[order], axis=1) - cells.size[order]
            least = part.column("least").to_numpy(zero_copy_only=False)
            reach = np.maximum((q * q).sum(axis=1) + projection.square - 2 * least, 0.0)
            open_ = np.take_along_axis(distance, order, 1) <= limit * reach[:, None]
            at, nth = np.nonzero((before >= step[0]) & (before < step[1]) & open_)
            if not len(at):
                continue
            cell = order[at, nth]
            times = cells.blocks[cell]
            bundle = np.repeat(cells.bundle[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, cell = np.repeat(at, times), np.repeat(cell, times)
            # one visit for all cells of a bundle
            place = np.lexsort((cell, bundle, at))
            at, cell, bundle = at[place], cell[place], bundle[place]
            new = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(bundle) != 0)])
            owners = at[new]
            rows_ = np.add.reduceat(cells.size[cell] // cells.blocks[cell], new)
            listed = pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)], pa.int32()), pa.array(cells.number[cell], pa.int32()))
            n = len(new)
            yield arrow.batch(
                VISIT_ARROW,
                [bundle[new], np.ones(n, np.int32), part.column("query_id").take(pa.array(owners)), part.column("vector").take(pa.array(owners)),
                 least[owners], pa.nulls(n, pa.int32()), listed, rows_],
            )


def verified(x: np.ndarray, ids: np.ndarray, cell: np.ndarray, visits: pa.RecordBatch, dimension: int, k: int):
    """The best ``k`` rows of the visited cells of a bundle for each query, none below the query's ``least``."""
    q, asked = matrix(visits.column("vector"), dimension), visits.column("id").to_numpy()
    least = visits.column("least").to_numpy(zero_copy_only=False)
    offsets = visits.column("cells").offsets.to_numpy() - visits.column("cells").offsets[0].as_py()
    taken = visits.column("cells").flatten().to_numpy()
    out, width = [], max(1, HELD_PAIRS // max(1, len(x)))
    for start in range(0, len(q), width):
        s = slice(start, min(start + width, len(q)))
        inside = taken[offsets[s.start] : offsets[s.stop]]
        numbers, place = np.unique(inside, return_inverse=True)
        wanted = np.zeros((s.stop - s.start, len(numbers)), bool)
        wanted[np.repeat(np.arange(s.stop - s.start), np.diff(offsets[s.start : s.stop + 1])), place] = True
        near_rows = np.flatnonzero(np.isin(cell, numbers))
        if not len(near_rows):
            continue
        allowed = wanted[:, np.searchsorted(numbers, cell[near_rows])]
        rough = np.where(allowed, q[s] @ x[near_rows].T, -np.inf)
        rough[asked[s][:, None] == ids[near_rows][None, :]] = -np.inf
        floor = least[s].copy()
        if rough.shape[1] > k:
            floor = np.maximum(floor, -np.partition(-rough, k - 1, axis=1)[:, k - 1])
        # the matrix product may differ in the last digits from one place to another; the scores below do not
        slack = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(floor), floor, 0.0)))
        at, near = np.nonzero((rough >= (floor - slack)[:, None]) & np.isfinite(rough))
        near = near_rows[near]
        score = (q[s][at] * x[near]).sum(axis=1)
        order = np.lexsort((ids[near], -score, at))
        at, near, score = at[order], near[order], score[order]
        best_ = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((asked[s][at[best_]], ids[near[best_]], score[best_]))
    if out:
        yield arrow.batch(FOUND_ARROW, [np.concatenate(c) for c in zip(*out, strict=True)])


def bundle_batches(batches: Iterator[pa.RecordBatch], dimension: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by bundle, its vectors first, then the queries that visit it."""
    place, parts, held = None, [], None
    for rows in batches:
        bundle, kind = rows.column("bundle").to_numpy(), rows.column("kind").to_numpy()
        cuts = np.flatnonzero((np.diff(bundle) != 0) | (np.diff(kind) != 0)) + 1
        for low, high in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
            if low == high:
                continue
            part = rows.slice(low, high - low)
            if bundle[low] != place:
                place, parts, held = bundle[low], [], None
            if kind[low] == 0:
                parts.append((matrix(part.column("vector"), dimension), part.column("id").to_numpy(), part.column("cell").to_numpy()))
                continue
            if held is None:
                held = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
            yield from verified(*held, part, dimension, k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, ties to the smaller id, as ``query_id, rank, vec_id, score``.

    A query's rows are at most ``k`` for each bundle of its first step, and after that those better than its k-th.
    """
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search(
    vectors: DataFrame, wanted, k: int, key: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE
) -> DataFrame:
    """The ``k`` nearest rows of each query by inner product: ``query_id, rank, vec_id, score``.

    ``wanted`` is a condition on ``vec_id`` that picks the queries; the candidates are all rows but those with the query's
    own id. Missing ids, missing, empty or zero vectors and those with a missing or non-finite component take no part, nor
    do vectors of another length than most have (of equally frequent lengths, the longest). Repeated ids are one query (with
    the least of their vectors) and, with
    equal vectors, one candidate. Ties go to the smaller id. With fewer than ``k`` candidates all are returned; an empty
    table gives an empty one. Scores are inner products of the original vectors in double precision. Other
    columns are not read.
    """
    return search_steps(vectors, wanted, k, key, vector, confidence)[0]


def search_steps(
    vectors: DataFrame, wanted, k: int, key: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE
) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``search``, and for each step the written visits, with the ``rows`` that each verifies."""
    spark = arrow.prepared(vectors.sparkSession)
    rows = valid_vectors(vectors, key, vector)
    length = F.aggregate("vector", F.lit(0.0), lambda total, v: total + v * v)
    by_size = rows.groupBy(F.size("vector").alias("dimension")).agg(F.count("*").alias("n"), F.max(length).alias("square"))
    most = by_size.orderBy(F.desc("n"), F.desc("dimension")).first()
    dimension, count, square = (most["dimension"], most["n"], most["square"]) if most else (1, 0, 1.0)
    rows = rows.where(F.size("vector") == dimension)
    draws = np.random.default_rng(SEED).standard_normal((dimension + 1, PROJECTIONS))
    projection = Projection(draws, float(square))

    step = -(-max(1, count) // SAMPLE_ROWS)
    # only the projections of the sample go to the driver
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).select("vec_id", "vector")
    places = sample.mapInArrow(lambda it: index_batches(it, projection, Tree(0, np.zeros(0, int), np.zeros(0))), INDEXED)
    flat = places.select("place").toArrow().column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    tree = build_tree(flat.reshape(-1, PROJECTIONS), min(MOST_CELLS, -(-count // CELL_ROWS)))
    indexed = materialize(rows.mapInArrow(lambda it: index_batches(it, projection, tree), INDEXED), "vectors")

    edges = [f(F.get("place", F.lit(j))).alias(f"{n}{j}") for n, f in (("low", F.min), ("high", F.max)) for j in range(PROJECTIONS)]
    # one row per cell, MOST_CELLS at most
    boxes = indexed.groupBy("cell").agg(F.count("*").alias("n"), *edges).orderBy("cell").toPandas()
    sizes = boxes["n"].to_numpy(np.int64)
    cells = Cells(
        boxes["cell"].to_numpy(np.int32),
        boxes[[f"low{j}" for j in range(PROJECTIONS)]].to_numpy(float),
        boxes[[f"high{j}" for j in range(PROJECTIONS)]].to_numpy(float),
        sizes,
        *bundles(sizes),
    )
    where_ = list(zip(cells.number.tolist(), cells.bundle.tolist(), cells.blocks.tolist(), strict=True))
    stored = spark.createDataFrame(where_, "cell int, bundle long, blocks long")
    placed = indexed.join(F.broadcast(stored), "cell").select(
        (F.col("bundle") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).alias("bundle"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"),
        "vector", F.lit(None).cast("double").alias("least"), "cell", F.lit(None).cast("array<int>").alias("cells"), F.lit(0).cast("long").alias("rows"),
    )
    placed = materialize(placed, "bundles")
    queries = materialize(indexed.where(wanted).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")), "queries")
    limit = chi_square_quantile(confidence, PROJECTIONS)
    nearest = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    reached, steps = 0, []
    while reached < max(1, count):
        span = (reached, max(FIRST_ROWS * k, reached * GROWTH))
        kth = nearest.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        asking = queries.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        visits = asking.select("query_id", "vector", "least").mapInArrow(
            lambda it, span=span: visit_batches(it, dimension, projection, cells, span, limit), PLACED
        )
        visits = materialize(visits, "visits")
        reached = span[1]
        if visits.isEmpty():
            # every test holds, or no cell begins at this step's rows
            continue
        steps.append(visits)
        # only bundles that are visited are laid out
        there = placed.join(visits.select("bundle").distinct(), "bundle", "left_semi").select(visits.columns)
        met = there.unionByName(visits).repartition("bundle").sortWithinPartitions("bundle", "kind")
        found = met.mapInArrow(lambda it: bundle_batches(it, dimension, k), FOUND)
        nearest = materialize(best(nearest.select("query_id", "vec_id", "score").unionByName(found), k), "nearest")
    return nearest.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), steps
