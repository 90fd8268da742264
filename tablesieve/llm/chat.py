"""Conversations as token sequences in a prefix tree: turns that conversations share are written once.

A turn is formatted as ``<turn:ROLE>``, a line break, the text, ``</turn>`` and a line break. In texts a backslash is
doubled and a backslash goes before ``<turn:`` and ``</turn>``; in roles before a backslash and ``>``. So every formatted
turn can be taken apart again. Head, text and tail are encoded on their own, and the loss covers the text of assistant turns.

Conversations that begin with the same turns share the nodes of those turns. A node belongs to the smallest conversation
that has it. What a conversation owns is one chain down to its end; it hangs on another chain at the turn where the two
part. Depth-first order goes down a chain first, then to the chains that part from it, the deepest first: it is the order of
the lists of (parting turn, owner) from the root, which pointer jumping finds in a number of rounds that is the logarithm
of their length. A token attends to its own chain and to one interval for each chain above it.

Nothing is gathered per conversation or tree: turns are placed by one global sort, prefixes are named by running sums of
digests (two of 60 bits each), and sums over a conversation, a tree or everything go through totals per partition. A
conversation or a first turn with a third of all rows is so many rows of ordinary joins, whose other side has one row per key.

Defined cases: null texts and roles are empty; turns of equal number are ordered by role and text; null turns come first; rows without
conv_id are one conversation; a text may hold anything, markers and special tokens included; an empty table gives an
empty output. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tablesieve.llm.encoding import encoder, library_tokenizer
from tablesieve.runtime import materialize

# The template.
HEAD, CLOSE, TAIL = "<turn:", ">\n", "</turn>\n"
TAUGHT = "assistant"
TURN = re.compile(r"<turn:((?:[^\\>]+|\\.)*)>\n((?:[^\\<]+|\\.|<(?!/turn>|turn:))*)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)

TURNS = "conv string, turn long, role string, text string"


def escaped_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn:", "\\<turn:").replace("</turn>", "\\</turn>")


def escaped_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(">", "\\>")


def plain(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def segments(role: str, text: str) -> tuple[str, str, str]:
    """Head, text and tail of a formatted turn."""
    return HEAD + escaped_role(role) + CLOSE, escaped_text(text), TAIL


def taken_apart(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of the turns of a formatted text; anything else is an error."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((plain(found[1]), plain(found[2])))
        at = found.end()
    return turns


# Running sums over rows of any number


def laid_out(rows: DataFrame, group: list[str], *order: str | Column) -> DataFrame:
    """The rows in one global order, written down, with their position ``_at`` and partition ``_part``."""
    placed = rows.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    return materialize(placed.withColumn("_part", F.shiftright("_at", 33)), "laid-out")


def with_running(placed: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over the earlier rows of the same group; ``placed`` is laid out by the group and read twice.

    Within a partition a window streams over its rows; only (group, partition) totals are combined beyond it.
    """
    here = W.partitionBy("_part", *group).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = placed.groupBy("_part", *group).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    # a group with rows everywhere has as many totals as there are partitions
    earlier = W.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("_part", *group, *[F.coalesce(F.sum(f"_{n}").over(earlier), zero).alias(f"_{n}") for n in sums])
    inside = placed.select(*placed.columns, *[F.coalesce(F.sum(c).over(here), zero).alias(n) for n, c in sums.items()])
    joined = inside.join(before, ["_part", *group])
    return joined.select(*placed.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


# The tree


def turns_of(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with names that sort and join: ``conv, turn, role, text``."""
    empty = F.lit("")
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), empty).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
    )


def digest_part(first: int) -> Column:
    """Sixty bits of the digest of a turn at its place."""
    named = F.concat_ws(":", F.col("place").cast("string"), F.length("role").cast("string"), F.concat("role", F.lit(":"), "text"))
    return F.conv(F.substring(F.sha2(named, 256), first, 15), 16, 10).cast("decimal(20,0)")


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """Every turn with its place and the owner of its node: ``conv, place, owner, role, text``, written down."""
    placed = laid_out(turns, ["conv"], F.asc_nulls_first("turn"), "role", "text")
    placed = with_running(placed, ["conv"], {"place": F.lit(1).cast("long")})
    placed = materialize(placed.withColumn("a", digest_part(1)).withColumn("b", digest_part(16)), "places")
    narrow = placed.select("conv", "place", "a", "b", "_at", "_part")
    sums = with_running(narrow, ["conv"], {"before_a": F.col("a"), "before_b": F.col("b")}).select(
        "conv", "place", (F.col("a") + F.col("before_a")).alias("prefix_a"), (F.col("b") + F.col("before_b")).alias("prefix_b")
    )
    sums = materialize(sums, "prefixes")
    node = ["place", "prefix_a", "prefix_b"]
    owners = sums.groupBy(*node).agg(F.min("conv").alias("owner"))
    owned = materialize(sums.join(owners, node).select("conv", "place", "owner"), "owners")
    return materialize(placed.select("conv", "place", "role", "text").join(owned, ["conv", "place"]), "turns")


def chains_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and chains of owned turns, written down.

    ``convs(conv, chain, turns)``: the chain that a conversation ends in, and its length. ``chains(chain, parting, way)``:
    the turn from which a conversation owns its nodes, and the list of (-parting, chain) from the root.
    """
    own = F.col("owner") == F.col("conv")
    last = F.max(F.struct("place", "owner"))
    ends = turns.groupBy("conv").agg(
        last["owner"].alias("chain"), F.count("*").alias("turns"), F.min(F.when(own, F.col("place"))).alias("parting"),
        F.max(F.when(~own, F.struct("place", "owner")))["owner"].alias("above"),
    )
    ends = materialize(ends, "ends")
    hop = F.struct((-F.col("parting")).alias("up"), F.col("conv").alias("chain"))
    ways = materialize(
        ends.where(F.col("parting").isNotNull()).select(F.col("conv").alias("chain"), "parting", "above", F.array(hop).alias("way")), "ways"
    )
    # each round doubles how far up a list reaches
    while not ways.where(F.col("above").isNotNull()).isEmpty():
        beyond = ways.select(F.col("chain").alias("above"), F.col("way").alias("higher"), F.col("above").alias("next"))
        joined = ways.join(beyond, "above", "left").select(
            "chain", "parting", F.col("next").alias("above"),
            F.when(F.col("higher").isNull(), F.col("way")).otherwise(F.concat("higher", "way")).alias("way"),
        )
        ways = materialize(joined, "ways")
    return ends.select("conv", "chain", "turns"), ways.select("chain", "parting", "way")


NODES = "chain string, place long, head int, body int, tail int, taught boolean, ids binary"
NODES_ARROW = pa.schema(
    [("chain", pa.string()), ("place", pa.int64()), ("head", pa.int32()), ("body", pa.int32()), ("tail", pa.int32()),
     ("taught", pa.bool_()), ("ids", pa.binary())]
)


def encoded(turns: DataFrame, tokenizer: str) -> DataFrame:
    """The nodes with their tokens, each turn encoded once: ``chain, place, head, body, tail, taught, ids``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        for rows in batches:
            roles, texts = rows.column(2).to_pylist(), rows.column(3).to_pylist()
            parts = [ids_of(list(p)) for p in zip(*map(segments, roles, texts), strict=True)] or [[], [], []]
            lengths = [pa.array([len(x) // 4 for x in part], pa.int32()) for part in parts]
            taught = pa.array([r == TAUGHT for r in roles], pa.bool_())
            ids = pa.array([b"".join(p) for p in zip(*parts, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lengths, taught, ids], schema=NODES_ARROW)

    owned = turns.where(F.col("owner") == F.col("conv")).select("conv", "place", "role", "text")
    return owned.mapInArrow(encode, NODES)


def format_tree(conversations: DataFrame, tokenizer: str, uri: str) -> None:
    """Formats all conversations and writes the prefix trees to ``uri``.

    ``uri/nodes``: one row per node in depth-first order: ``tree, chain, place, start`` (of its first token in the tree),
    ``position`` (position id of its first token; those after it count up), ``head, body, tail`` (tokens of its parts),
    ``taught`` (whether the loss covers the text), ``attends`` (intervals of the tree's tokens before the node that it
    attends to, from the root down) and ``ids`` (little-endian unsigned 32-bit).
    ``uri/convs``: for each conversation ``conv_id, turns`` and the ``spans`` (chain, first, last) of its nodes.
    """
    turns = prefix_nodes(turns_of(conversations))
    convs, chains = chains_of(turns)
    nodes = materialize(encoded(turns, tokenizer), "nodes")
    tokens = F.col("head") + F.col("body") + F.col("tail")
    # position ids run along a conversation: own tokens before a node, and those of the chains above up to the partings
    along = laid_out(nodes.select("chain", "place", tokens.cast("long").alias("tokens")), ["chain"], "place")
    along = materialize(with_running(along, ["chain"], {"inside": F.col("tokens")}).drop("_at", "_part"), "along")
    totals = along.groupBy("chain").agg(F.sum("tokens").alias("tokens"))
    # lists of hops sort as the trees are written; one row per chain
    ranked = laid_out(chains.join(totals, "chain"), [], "way").withColumn("tree", F.get("way", F.lit(0))["chain"])
    ranked = materialize(with_running(ranked, [], {"from": F.col("tokens")}), "ranks")
    heads = ranked.where(F.size("way") == 1).select("tree", F.col("from").alias("tree_from"))
    starts = ranked.join(heads, "tree").select("chain", "tree", "way", "parting", (F.col("from") - F.col("tree_from")).alias("from"))
    starts = materialize(starts, "starts")
    # what a chain sees of each chain above it: the tokens up to the turn where the next one parts
    hops = starts.where(F.size("way") > 1).select(
        "chain", F.posexplode(F.slice("way", 1, F.size("way") - 1)).alias("level", "hop"), "way"
    ).select("chain", "level", F.col("hop.chain").alias("above"), (-F.get("way", F.col("level") + 1)["up"]).alias("until"))
    reach = along.select(F.col("chain").alias("above"), (F.col("place") + 1).alias("until"), (F.col("inside") + F.col("tokens")).alias("seen"))
    seen = hops.join(reach, ["above", "until"]).join(starts.select(F.col("chain").alias("above"), F.col("from").alias("above_from")), "above")
    interval = F.struct("level", F.col("above_from").alias("from"), (F.col("above_from") + F.col("seen")).alias("to"))
    intervals = seen.groupBy("chain").agg(F.sort_array(F.collect_list(interval)).alias("above"), F.sum("seen").alias("above_tokens"))
    placed = starts.join(intervals, "chain", "left").select(
        "chain", "tree", "from", F.coalesce("above_tokens", F.lit(0)).alias("above_tokens"),
        F.coalesce(F.transform("above", lambda i: F.struct(i["from"].alias("from"), i["to"].alias("to"))),
                   F.array().cast("array<struct<from:bigint,to:bigint>>")).alias("above"),
    )
    own = F.struct(F.col("from"), (F.col("from") + F.col("inside")).alias("to"))
    out = nodes.join(along.select("chain", "place", "inside"), ["chain", "place"]).join(placed, "chain").select(
        "tree", "chain", "place", (F.col("from") + F.col("inside")).alias("start"), (F.col("above_tokens") + F.col("inside")).alias("position"),
        "head", "body", "tail", "taught", F.when(F.col("inside") > 0, F.concat("above", F.array(own))).otherwise(F.col("above")).alias("attends"), "ids",
    )
    out.orderBy("tree", "start").write.parquet(f"{uri}/nodes")
    span = F.transform(
        "way",
        lambda hop, i: F.struct(
            hop["chain"].alias("chain"), (-hop["up"]).alias("first"),
            F.coalesce(-F.get("way", i + 1)["up"] - 1, F.col("turns") - 1).alias("last"),
        ),
    )
    listed = convs.join(chains.select("chain", "way"), "chain")
    conv_id = F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id")
    listed.select(conv_id, "turns", span.alias("spans")).write.parquet(f"{uri}/convs")


READ = "chain string, place long, role string, text string, loss string, chars long"
READ_ARROW = pa.schema(
    [("chain", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.string()), ("chars", pa.int64())]
)


def read_turns(spark: SparkSession, tokenizer: str, uri: str) -> DataFrame:
    """The turns of all conversations as the output has them: ``conv_id, at, role, text, loss, chars``.

    Every node is decoded and taken apart once; ``loss`` is the plain text under the loss mask, missing where there is none.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = library_tokenizer(tokenizer)
        for rows in batches:
            columns = {n: rows.column(n).to_pylist() for n in ("head", "body", "taught", "ids")}
            ids = [np.frombuffer(x, "<u4") for x in columns["ids"]]
            covered = [x[h : h + b] for x, h, b in zip(ids, columns["head"], columns["body"], strict=True)]
            formatted = decoder.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
            under = decoder.decode_batch([x.tolist() for x in covered], skip_special_tokens=False)
            turns = [taken_apart(f)[0] for f in formatted]
            loss = [plain(u) if taught else None for u, taught in zip(under, columns["taught"], strict=True)]
            made = [[r for r, _ in turns], [t for _, t in turns], loss, [len(f) for f in formatted]]
            arrays = [pa.array(m, f.type) for m, f in zip(made, list(READ_ARROW)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("chain"), rows.column("place"), *arrays], schema=READ_ARROW)

    nodes = spark.read.parquet(f"{uri}/nodes").select("chain", "place", "head", "body", "taught", "ids").mapInArrow(decode, READ)
    spans = spark.read.parquet(f"{uri}/convs").select("conv_id", F.explode("spans").alias("span"))
    wanted = spans.select("conv_id", F.col("span.chain").alias("chain"), F.explode(F.sequence("span.first", "span.last")).alias("place"))
    return wanted.join(nodes, ["chain", "place"]).withColumnRenamed("place", "at").drop("chain")


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
SUMMARY_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def summary(spark: SparkSession, tokenizer: str, uri: str) -> DataFrame:
    """Digests of every conversation, read back from the output: ``conv_id`` and the columns of SUMMARY.

    A digest takes a conversation's turns one after the other, so they stream through one task, which holds one turn
    at a time.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, n, turns, chars, loss, formatted = none, 0, None, 0, None, 0
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * len(SUMMARY_ARROW)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SUMMARY_ARROW, strict=True)], schema=SUMMARY_ARROW)

        for rows in batches:
            for row in zip(*[rows.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "chars")], strict=True):
                if conv is none or row[0] != conv:
                    if conv is not none:
                        done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))
                    conv, n, turns, chars, loss, formatted = row[0], 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                n, formatted = n + 1, formatted + row[4]
                turns.update(f"{row[1]}\n{row[2]}\n".encode())
                if row[3] is not None:
                    chars += len(row[3])
                    loss.update(row[3].encode())
            yield out()
        if conv is not none:
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))
        yield out()

    read = read_turns(spark, tokenizer, uri).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return read.mapInArrow(digests, SUMMARY)
