"""Merkle manifest of a dataset: a persistent tree whose versions share every node that a change leaves alone.

Every row is a leaf; per language the leaves ascend by id, and every eight consecutive nodes (the last run may be
shorter, even one) become one until a single node, the subroot, is left; the subroots in order of language become the
root the same way. A tree is stored in aligned blocks of 8^4 = 4096 nodes: a task builds the four levels of a block,
and the tops of the blocks are the nodes of the next storey, where the same is done again. So no task sees more than
4096 nodes, however many rows one language has, and the number of storeys grows with the logarithm of the rows.

A row that is presented with another leaf than the stored one makes a version. Within its block only its ancestors
are copied, everything else is shared; the copied top of the block goes on as a row of its own up the storeys above,
along the stored path of the block. The new root is the last copy. A row presented as stored makes no version: all its nodes are shared.

Defined cases: a null field is ``-``; null ids come first and null languages are a tree of their own, the first one;
rows with equal ids are ordered by their leaves, equal rows are interchangeable; an empty table gives no rows. Columns
other than the five fields are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesieve.runtime import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_BITS, BLOCK_LEVELS = 3, 4
FAN, BLOCK_BITS = 1 << FAN_BITS, FAN_BITS * BLOCK_LEVELS
DIGEST = 32

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The one tree of the subroots.
TOP = ""

NODE_ARROW = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])
PATH_ARROW = pa.schema(
    [("tree", pa.string()), ("pos", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())]
)
LEAF_ARROW = pa.schema(
    [("tree", pa.string()), ("block", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.binary()), ("subroot", pa.binary()),
     ("root", pa.binary()), ("proof", pa.binary()), ("copies", pa.list_(pa.binary()))]
)
NODE_DDL = "tree string, pos long, size long, digest binary"
PATH_DDL = "tree string, pos long, path binary, subroot binary, root binary"
LEAF_DDL = "tree string, block long, doc_id long, leaf binary, subroot binary, root binary, proof binary, copies array<binary>"


def field(value: Column) -> Column:
    """One field of a leaf: its length in bytes and its value, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(row[c]) for c in FIELDS]), 256))


def tampers(doc_id: Column) -> Column:
    """Whether a row is presented with its text in lower case."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def presented_text(doc_id: Column, text: Column) -> Column:
    return F.when(tampers(doc_id), F.translate(text, UPPER, UPPER.lower())).otherwise(text)


def parent(children: list[bytes]) -> bytes:
    """Digest of a run of nodes; digests go in as hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def levels_of(size: int) -> int:
    """Levels above ``size`` nodes until one is left, as far as a block goes."""
    levels = 0
    while size > 1 and levels < BLOCK_LEVELS:
        size, levels = -(-size // FAN), levels + 1
    return levels


def block_levels(nodes: list[bytes], size: int) -> list[list[bytes]]:
    """The levels of one block, from its nodes to its top, in a tree that has ``size`` nodes at the lowest of them."""
    levels = [nodes]
    for _ in range(levels_of(size)):
        below = levels[-1]
        levels.append([parent(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


# A path is a string of steps: one byte each for the siblings on the left and on the right, then their digests.


def step(nodes: list[bytes], at: int) -> bytes:
    start = at - at % FAN
    before, after = nodes[start:at], nodes[at + 1 : start + FAN]
    return bytes((len(before), len(after))) + b"".join(before) + b"".join(after)


def steps(path: bytes):
    """``(siblings on the left, siblings on the right)`` of a path, upwards."""
    at = 0
    while at < len(path):
        left, right = path[at] * DIGEST, path[at + 1] * DIGEST
        at += 2
        yield path[at : at + left], path[at + left : at + left + right]
        at += left + right


def climb(digest: bytes, path: bytes) -> list[bytes]:
    """The copies that a changed node makes of its ancestors along a path, upwards."""
    copies = []
    for before, after in steps(path):
        digest = hashlib.sha256((before + digest + after).hex().encode()).digest()
        copies.append(digest)
    return copies


def own_path(levels: list[list[bytes]], at: int) -> bytes:
    """The steps of the ``at``-th node from the lowest of ``levels`` to their top."""
    return b"".join(step(level, at >> FAN_BITS * i) for i, level in enumerate(levels[:-1]))


def siblings(path: bytes) -> bytes:
    """Hex text of all siblings of a path, in order."""
    return b"".join(before + after for before, after in steps(path)).hex().encode()


def block_of(pos: Column | str) -> Column:
    return F.shiftright(pos, BLOCK_BITS)


def sorted_nodes(table: pa.Table, *names: str) -> list[list]:
    table = table.sort_by("pos")
    return [table.column(n).to_pylist() for n in names]


def block_tops(nodes: DataFrame) -> DataFrame:
    """The next storey above nodes(tree, pos, size, digest): the tops of their blocks, with the same columns."""

    def tops(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        digests, sizes = sorted_nodes(table, "digest", "size")
        top = block_levels(digests, sizes[0])[-1][0]
        return pa.table([[key[0].as_py()], [key[1].as_py()], [-(-sizes[0] >> BLOCK_BITS)], [top]], schema=NODE_ARROW)

    placed = nodes.select("tree", "pos", "size", "digest", block_of("pos").alias("block"))
    return placed.groupBy("tree", "block").applyInArrow(tops, NODE_DDL)


def storeys(nodes: DataFrame) -> list[DataFrame]:
    """Written storeys from nodes(tree, pos, size, digest) up to the one with a single node for every tree."""
    found = [nodes]
    while True:
        found.append(materialize(block_tops(found[-1]), "storey"))
        if found[-1].where(F.col("pos") > 0).isEmpty():
            return found


def paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The path of every node to the root, written: ``tree, pos, path, subroot, root``; ``above`` has those of the next storey."""

    def joined(key: tuple[pa.Scalar, ...], table: pa.Table, up: pa.Table) -> pa.Table:
        positions, digests, sizes = sorted_nodes(table, "pos", "digest", "size")
        levels = block_levels(digests, sizes[0])
        rest, subroot, root = (up.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        found = [own_path(levels, at) + rest for at in range(len(digests))]
        n = len(found)
        return pa.table([[key[0].as_py()] * n, positions, found, [subroot] * n, [root] * n], schema=PATH_ARROW)

    placed = nodes.select("tree", "pos", "size", "digest", block_of("pos").alias("block"))
    blocks = above.select("tree", F.col("pos").alias("block"), "path", "subroot", "root")
    return materialize(
        placed.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(joined, PATH_DDL), "paths"
    )


def ordered_leaves(docs: DataFrame) -> DataFrame:
    """All leaves in their places: ``tree, pos, size, doc_id, digest, presented``, written down.

    One global sort places them; where a language's rows begin follows from counts per (tree, partition). ``presented``
    is missing where it is the stored leaf.
    """
    row = {c: F.col(c) for c in FIELDS}
    stored = leaf(row)
    # the text is lower-cased and hashed again for the tampered rows alone
    again = F.when(tampers(F.col("doc_id")), leaf(row | {"text": presented_text(F.col("doc_id"), F.col("text"))}))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("-")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        stored.alias("digest"), again.alias("again"), F.monotonically_increasing_id().alias("copy"),
    )
    placed = materialize(
        leaves.withColumn("presented", F.when(F.col("again") != F.col("digest"), F.col("again"))).drop("again")
        # equal rows can be many; where they were read keeps them apart
        .orderBy("tree", F.asc_nulls_first("doc_id"), "digest", "copy").drop("copy")
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)),
        "leaves",
    )
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = W.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("tree", "part", "first", before.alias("before"), F.sum("rows").over(whole).alias("size"))
    return placed.join(starts, ["tree", "part"]).select(
        "tree", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "size", "doc_id", "digest", "presented"
    )


def top_nodes(subroots: DataFrame) -> DataFrame:
    """Subroots in order of language as the nodes of the top tree, with the ``name`` of their tree; one row per language."""
    everything = W.partitionBy(F.lit(TOP))
    return subroots.select(
        F.lit(TOP).alias("tree"), (F.row_number().over(everything.orderBy("tree")) - 1).cast("long").alias("pos"),
        F.count("*").over(everything).alias("size"), "digest", F.col("tree").alias("name"),
    )


@dataclass
class Manifest:
    """The current tree, in written tables."""

    leaves: DataFrame        # tree, pos, size, doc_id, digest, presented
    trees: list[DataFrame]   # storeys of all languages, leaves first: tree, pos, size, digest
    top: list[DataFrame]     # storeys of the top tree, subroots first; the last is the root
    block_paths: DataFrame   # tree, pos of each block of leaves, path to the root, subroot, root


def manifest(docs: DataFrame) -> Manifest:
    """Builds the tree of all rows: storeys upwards, then the paths of the blocks downwards."""
    leaves = ordered_leaves(docs)
    trees = storeys(leaves)
    named = materialize(top_nodes(trees[-1]), "subroots")
    top = storeys(named)
    known = top[-1].select("tree", "pos", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for storey in reversed(top[:-1]):
        known = paths(storey, known)
    # from the top tree's lowest nodes to the languages they stand for
    known = known.select("pos", "path", "root").join(named.select("pos", "name", "digest"), "pos").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"
    )
    for storey in reversed(trees[1:-1]):
        known = paths(storey, known)
    return Manifest(leaves, trees, top, known)


def versions(tree: Manifest) -> DataFrame:
    """Every leaf with its proof and, where it is presented otherwise, the copies of its version inside its block.

    ``tree, block, doc_id, leaf, subroot, root, proof, copies``: ``copies`` holds the changed leaf and the copied
    ancestors within the block, upwards; it is missing where everything is shared. Written down.
    """

    def proven(key: tuple[pa.Scalar, ...], table: pa.Table, up: pa.Table) -> pa.Table:
        digests, sizes, ids, presented = sorted_nodes(table, "digest", "size", "doc_id", "presented")
        levels = block_levels(digests, sizes[0])
        rest, subroot, root = (up.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        outside = siblings(rest)
        proofs, copies, beyond = [], [], b""
        for at, changed in enumerate(presented):
            if at % FAN == 0:
                # the eight leaves of a run share all but their own run
                beyond = siblings(own_path(levels[1:], at >> FAN_BITS)) + outside
            own = step(digests, at) if len(levels) > 1 else b""
            proofs.append(hashlib.sha256(siblings(own) + beyond).digest())
            copies.append(None if changed is None else [changed, *climb(changed, own_path(levels, at))])
        n = len(ids)
        fixed = [[key[0].as_py()] * n, [key[1].as_py()] * n, ids, digests, [subroot] * n, [root] * n]
        return pa.table([*fixed, proofs, copies], schema=LEAF_ARROW)

    placed = tree.leaves.withColumn("block", block_of("pos"))
    blocks = tree.block_paths.select("tree", F.col("pos").alias("block"), "path", "subroot", "root")
    made = placed.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(proven, LEAF_DDL)
    return materialize(made, "versions")


def continued(made: DataFrame, tree: Manifest) -> DataFrame:
    """Versions with the copies above their blocks: ``copies`` goes on up to the new root.

    The versions are rows like any others here; each meets the stored path of its block.
    """
    changed = made.where(F.col("copies").isNotNull())
    at_path = changed.join(tree.block_paths.select("tree", F.col("pos").alias("block"), "path"), ["tree", "block"])
    names = made.columns
    place = names.index("copies")

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            copies, ways = rows.column(place).to_pylist(), rows.column(len(names)).to_pylist()
            higher = [c + climb(c[-1], way) for c, way in zip(copies, ways, strict=True)]
            kept = [rows.column(i) for i in range(len(names))]
            kept[place] = pa.array(higher, LEAF_ARROW.field("copies").type)
            yield pa.RecordBatch.from_arrays(kept, names=names)

    return at_path.select(*names, "path").mapInArrow(raised, made.schema)


def verify(docs: DataFrame) -> DataFrame:
    """Every row's leaf, proof and the root that its presented leaf leads to.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, digests in lower-case hex.
    """
    tree = manifest(docs)
    made = versions(tree)
    shared = made.where(F.col("copies").isNull()).withColumn("folded", F.col("root"))
    moved = continued(made, tree).withColumn("folded", F.element_at("copies", -1))

    def text(name: str) -> Column:
        return F.lower(F.hex(name))

    return shared.unionByName(moved).select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
