"""Exact Jaccard self-join of documents on word shingles, by a token-group matrix.

Documents with equal shingle sets are one set. Sets are partitioned into groups of similar ones: sets with a common
min-hash key are compared, in blocks of bounded size. Those connected by links form groups of their own, cut to a bounded
number of members; the others are grouped by their first key and its block. Within a group nothing is left to find: its
sets are connected, or have been compared.

The token-group matrix says which groups have which tokens. Tokens have one order for all sets, those found often in a sample come
last. A link takes 8/9 of the smaller set, and four fifths of the larger one, so it has one of the first ninth of the smaller set's tokens among
the first fifth of the larger one's. Such tokens of the members of a group are a row of the matrix, which is laid out by token and joined with the sets.
A few rare tokens more are asked for than this ninth, and as many must be met. Of two groups, the one with fewer members sends its sets to the other:
as smaller sets to look for larger ones there, as larger ones to be looked for, or both. So a large group of near copies costs a row for each set that
stands near it, not for each of its own. Sets that are sent come to the first tokens of the members, and where they share as many of them as a link needs,
to the sketches of the members, many sets to a group at once; what still qualifies is compared in full. A set and a group are a row, never a set
and a member.

A passage that many sets share is in the last eight ninths of each where it does not make links; then it costs a row per group in the matrix
and no pairs. A large group of near copies is a few columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesieve.llm import arrow
from tablesieve.llm.components import components
from tablesieve.runtime import materialize

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80

BANDS, ROWS = 4, 3
#: One in so many texts is looked at for frequent tokens; so many findings make a token frequent.
SAMPLE_STEP, FREQUENT = 32, 3
#: Most frequent tokens kept. Any others only come earlier in the order, which costs time but loses no link.
MOST_FREQUENT = 200_000
#: Sets compared with one hub in one place, and members of a group.
BLOCK = 256
#: Tokens of a group's members that are looked up together; where there are more, members are compared one by one.
HELD_TOKENS = 4_000_000
KEPT_WORDS = 500_000

MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SETS = "row long, twin long, doc_id long, n_shingles long, set_id long, keys array<long>, tokens array<long>, rare int"
SETS_ARROW = pa.schema(
    [("row", pa.int64()), ("twin", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()),
     ("keys", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("rare", pa.int32())]
)
LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """``tokens(text)``: sorted distinct 64-bit hashes of the shingles of a text in UTF-8."""

    def __init__(self):
        self.kept: dict[bytes, int] = {}

    def words(self, text: bytes) -> np.ndarray:
        # of bytes: A-Z are lowered and exactly the contract's white space separates
        words = text.lower().split()
        new = set(words).difference(self.kept)
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
            new = set(words)
        for w in new:
            self.kept[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.kept.__getitem__, words), np.uint64, len(words))

    def tokens(self, text: bytes | None) -> np.ndarray:
        words = self.words(text or b"")
        if not len(words):
            return words
        width = min(SHINGLE, len(words))
        # a sequence of fewer words can only equal one of as many
        h = words[: len(words) - width + 1] + np.uint64(width)
        with np.errstate(over="ignore"):
            for k in range(1, width):
                h = h * MIX + words[k : len(words) - width + 1 + k]
            return np.unique(mixed(h))


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit name of a set: sets of equal names are taken for equal."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def group_keys(tokens: np.ndarray) -> np.ndarray:
    """One key per band, of ``ROWS`` min-hashes each."""
    with np.errstate(over="ignore"):
        least = np.array([(tokens * f).min() for f in FACTORS], np.uint64).reshape(BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            key = mixed(key * MIX + least[:, j])
    return key.view(np.int64)


def first_tokens(tokens: np.ndarray, names: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, int]:
    """The tokens of which a link needs one: rare ones first, whose number comes with them, then by how often the sample has them."""
    n = len(tokens)
    need = n - (PERCENT * n + 99) // 100 + 1
    often = np.zeros(n, np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
        often = np.where(names[at] == tokens, found[at], 0)
    order = np.argsort(often, kind="stable")[:need]
    return tokens[order].view(np.int64), int((often[order] == 0).sum())


def sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    schema = pa.schema([("token", pa.list_(pa.int64()))])
    for rows in batches:
        tokens = [shingler.tokens(t).view(np.int64) for t in rows.column(0).to_pylist()]
        yield arrow.batch(schema, [tokens])


def set_batches(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    """Name and size of every row's set; keys and tokens where a task meets a set for the first time."""
    shingler, (names, found), seen = Shingler(), frequent.value, set()
    for rows in batches:
        out = []
        for row, twin, doc, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            tokens = shingler.tokens(text)
            if not len(tokens):
                out.append((row, twin, doc, 0, None, None, None, None))
                continue
            name = set_id(tokens)
            new = name not in seen
            seen.add(name)
            keys = group_keys(tokens) if new else None
            first, rare = first_tokens(tokens, names, found) if new else (None, None)
            out.append((row, twin, doc, len(tokens), name, keys, first, rare))
        yield arrow.batch(SETS_ARROW, [list(c) for c in zip(*out, strict=True)] or [[]] * len(SETS_ARROW))


def frequent_tokens(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens often found in a sample of texts(text), sorted, and how often. Copies in the sample count once."""
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_STEP)) == 0).distinct()
    tokens = sample.mapInArrow(sample_batches, "token array<long>").select(F.explode("token").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = often.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    names, found = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(names)
    return names[order], found[order]


def sketch(tokens: np.ndarray) -> bytes:
    """The set by 32 bits of each token, sorted: sets have at most as many tokens in common as their sketches."""
    return np.sort(tokens.astype("<u4")).tobytes()


def counted_once(packed: bytes) -> np.ndarray:
    """Distinct numbers for the values of a sketch: equal values are told apart by how often they came before."""
    values = np.frombuffer(packed, "<u4").astype(np.int64)
    return (values << 31) + np.arange(len(values)) - np.searchsorted(values, values)


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, schema = Shingler(), pa.schema([("set_id", pa.int64()), ("sketch", pa.binary())])
    for rows in batches:
        out = []
        for name, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            tokens = shingler.tokens(text)
            if set_id(tokens) == name:  # else another row of the same hash
                out.append((name, sketch(tokens)))
        yield arrow.batch(schema, [list(c) for c in zip(*out, strict=True)] or [[], []])


def fifth_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size of a set and 32 bits of each of its first tokens."""
    schema = pa.schema([("set_id", pa.int64()), ("first", pa.binary())])
    for rows in batches:
        out = []
        for n, tokens in zip(rows.column(1).to_pylist(), rows.column(2), strict=True):
            values = tokens.values.to_numpy().astype("<u4")
            out.append(np.concatenate([np.array([n], "<u4"), np.sort(values)]).tobytes())
        yield arrow.batch(schema, [rows.column(0), out])


def first_common(n: int, least: int, most: int) -> int | None:
    """How many of its first tokens a set of ``n`` must share with those of any set of ``least`` to ``most`` that it links to; None: no such link.

    A link of sizes n and m has an overlap of (n + m) * PERCENT / (100 + PERCENT). What lies behind the first tokens of the one or the other
    can hold only a part of it; the rest is among the first tokens of both.
    """
    smallest, largest = max(least, -(-PERCENT * n // 100)), min(most, 100 * n // PERCENT)
    if smallest > largest:
        return None
    fewest = None
    for m in (smallest, largest):
        overlap = -(-PERCENT * (n + m) // (100 + PERCENT))
        for size in (n, m):
            behind = (PERCENT * size + 99) // 100 - 1
            fewest = overlap - behind if fewest is None else min(fewest, overlap - behind)
    # one less: rounding between the two ends
    return max(1, fewest - 1)


def fifth_bound_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by group and block, the members' first tokens first; gives the queries that share enough of theirs with all of them together."""
    schema = pa.schema([("query", pa.int64()), ("group", pa.int64()), ("down", pa.bool_())])
    place, held, union, out = None, [], None, []
    for rows in batches:
        for group, block, other, _, down, query, packed in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if (group, block) != place:
                place, held, union = (group, block), [], None
            values = np.frombuffer(packed, "<u4")
            if not other:
                held.append(values)
            elif held:
                if union is None:
                    least, most = min(int(h[0]) for h in held), max(int(h[0]) for h in held)
                    union = np.unique(np.concatenate([h[1:] for h in held]))
                n, first = int(values[0]), values[1:]
                needed = first_common(n, least if down else max(n, least), most)
                at = np.minimum(np.searchsorted(union, first), len(union) - 1)
                if needed is not None and int((union[at] == first).sum()) >= needed:
                    out.append((query, group, down))
        if out:
            yield arrow.batch(schema, [list(c) for c in zip(*out, strict=True)])
            out = []


class Members:
    """Sketches of the members of a group, looked up together."""

    def __init__(self, held: list[tuple[int, bytes]]):
        self.names, self.packed = [name for name, _ in held], [packed for _, packed in held]
        self.sizes = np.array([len(packed) // 4 for packed in self.packed], np.int64)
        self.values = None
        if self.sizes.sum() <= HELD_TOKENS:
            values = np.concatenate([counted_once(packed) for packed in self.packed])
            order = np.argsort(values, kind="stable")
            self.values, self.owners = values[order], np.repeat(np.arange(len(held)), self.sizes)[order]

    def common(self, query: np.ndarray) -> np.ndarray:
        """How many tokens of a query each member has at most."""
        if self.values is None:
            return np.array([len(np.intersect1d(query, counted_once(packed), assume_unique=True)) for packed in self.packed])
        low, high = np.searchsorted(self.values, query), np.searchsorted(self.values, query, "right")
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(self.owners[at], minlength=len(self.names))

    def nearest(self, name: int, packed: bytes, one: bool, down: bool = False) -> list[tuple[float, int]]:
        """Nearness and name of the other members whose bound allows a link; the nearest alone, where one is enough.

        Members smaller than the query are left out but for ``down``: they are queries themselves.
        """
        query = counted_once(packed)
        common = self.common(query)
        union = len(query) + self.sizes - common
        fits = np.flatnonzero((down | (self.sizes >= len(query))) & (100 * common >= PERCENT * union))
        found = [(common[k] / union[k], self.names[k]) for k in fits if self.names[k] != name]
        return [min(found, key=lambda f: (-f[0], f[1]))] if found and one else found

    def qualified(self, name: int, packed: bytes, one: bool) -> list[int]:
        """The members of ``nearest`` that are as large as the query at least."""
        return [member for _, member in self.nearest(name, packed, one)]


OPENED = "a long, b long, group long, one boolean, near double"
OPENED_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("group", pa.int64()), ("one", pa.bool_()), ("near", pa.float64())])


def open_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by group and block of queries, the members first; gives queries and members whose bound allows a link."""
    place, held, members, out = None, [], None, []
    for rows in batches:
        for group, block, other, one, down, name, packed in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if (group, block) != place:
                place, held, members = (group, block), [], None
            if not other:
                held.append((name, packed))
            elif held:
                members = members or Members(held)
                out.extend((name, member, group, one, near) for near, member in members.nearest(name, packed, one, down))
        if out:
            yield arrow.batch(OPENED_ARROW, [list(c) for c in zip(*out, strict=True)])
            out = []


def linked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by hub and block, the hub's own text first; gives the sets of the block that link to the hub."""
    shingler, place, hub, out = Shingler(), None, None, []
    for rows in batches:
        for name, block, other, member, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if (name, block) != place:
                place, hub = (name, block), None
            tokens = shingler.tokens(text)
            if set_id(tokens) != member:
                continue  # another row of the same hash
            if not other:
                hub = tokens
            elif hub is not None:
                if link(hub, tokens):
                    out.append((name, member))
        if out:
            yield arrow.batch(LINKS_ARROW, [list(c) for c in zip(*out, strict=True)])
            out = []


def by_hub(pairs: DataFrame, hubs: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    """``a, block, other, member, value`` of written pairs(a, b), placed by hub ``a`` and block, the hub first.

    Sets to compare with the same hub are dealt out in blocks. ``hubs(a, value)`` and ``sets(set_id, value)`` have one row each.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1)))
    placed = pairs.join(blocks.where(F.col("blocks") > 1), "a", "left").select("a", "b", block.alias("block"))
    # a block may turn out to have no members; then its hub is there alone
    first = blocks.join(hubs, "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), value)
    members = placed.join(sets.withColumnRenamed("set_id", "b"), "b")
    rows = first.select("a", "block", F.lit(0).alias("other"), F.col("a").alias("member"), value).unionByName(
        members.select("a", "block", F.lit(1).alias("other"), F.col("b").alias("member"), value)
    )
    return rows.repartition("a", "block").sortWithinPartitions("a", "block", "other")


def both_sides(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()


def dealt(asked: DataFrame, holders: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """``a, block, other, one, down, set_id, value``: queries and members of the groups they ask, placed by group and block, the members first.

    ``asked(a, b, one, down)`` is written and names group ``a`` and query ``b``. Queries of a group are dealt out in blocks, and each block has the
    group's members, so there are about as many rows as queries and members. Values are looked up once for both.
    """
    blocks = asked.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    no = F.lit(False)
    held = holders.select(F.col("group").alias("a"), "set_id").join(blocks, "a").select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.lit(0).alias("other"), no.alias("one"), no.alias("down"), "set_id",
    )
    queries = asked.withColumnRenamed("b", "set_id").join(blocks, "a").select(
        "a", F.pmod(F.xxhash64("set_id"), "blocks").alias("block"), F.lit(1).alias("other"), "one", "down", "set_id"
    )
    rows = held.unionByName(queries).join(values, "set_id").select("a", "block", "other", "one", "down", "set_id", value)
    return rows.repartition("a", "block").sortWithinPartitions("a", "block", "other")


def asked_and_held(asked: DataFrame, holders: DataFrame) -> DataFrame:
    return holders.select("set_id").unionByName(asked.select(F.col("b").alias("set_id"))).distinct()


def sharing(met: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """The written met(query, group, down) whose first tokens have enough in common; no text is looked at."""
    holders = materialize(groups.join(met.select("group").distinct(), "group", "left_semi").select("set_id", "group"), "met-holders")
    asked = met.select(F.col("group").alias("a"), F.col("query").alias("b"), F.lit(False).alias("one"), "down")
    # half as long, before they are dealt out
    firsts = sets.where(F.col("tokens").isNotNull()).select("set_id", "n_shingles", "tokens").mapInArrow(fifth_batches, "set_id long, first binary")
    firsts = firsts.join(asked_and_held(asked, holders), "set_id", "left_semi")
    # a set that several tasks met is there several times
    firsts = firsts.groupBy("set_id").agg(F.min("first").alias("first"))
    return dealt(asked, holders, firsts, "first").mapInArrow(fifth_bound_batches, "query long, group long, down boolean")


def linked(met: DataFrame, groups: DataFrame, texts: DataFrame, first_rows: DataFrame) -> DataFrame:
    """The links(a, b) that met(query, group, down) lead to: members by sketches, then in full."""
    met = materialize(met, "sharing")
    holders = groups.join(met.select("group").distinct(), "group", "left_semi").select("set_id", "group", "root")
    holders = materialize(holders, "holders")

    def opened_by(asked: DataFrame) -> DataFrame:
        wanted = asked_and_held(asked, holders)
        # not written down: they lie by set already, as the join wants them
        sketches = located(wanted, texts, first_rows).mapInArrow(sketch_batches, "set_id long, sketch binary").groupBy("set_id")
        return opened_groups(asked, holders, sketches.agg(F.min("sketch").alias("sketch")))

    # a query needs one link to a connected set of groups: the nearest member is compared first, others if that is no link
    keys = holders.select("group", F.coalesce("root", "group").alias("key"), F.col("root").isNotNull().alias("one")).distinct()
    asked = met.join(keys, "group").select(F.col("group").alias("a"), F.col("query").alias("b"), "one", "down")
    opened = opened_by(materialize(asked, "asked-groups")).join(keys.select("group", "key"), "group")
    opened = materialize(opened.select("a", "b", "key", "group", "one", "near"), "keyed-groups")
    nearest = opened.where("one").groupBy("a", "key").agg(F.max_by("b", F.struct("near", "b")).alias("b"))
    nearest = materialize(nearest.unionByName(opened.where("not one").select("a", "key", "b")), "nearest")
    links = materialize(confirmed(nearest, texts, first_rows), "links")
    members = holders.select(F.col("set_id").alias("b"), F.coalesce("root", "group").alias("key"))

    def found() -> DataFrame:
        return links.join(members, "b").select("a", "key").distinct()

    rest = opened.where("one").join(nearest, ["a", "key", "b"], "left_anti").join(found(), ["a", "key"], "left_anti")
    rest = materialize(rest.select("a", "b"), "other-members")
    if not rest.isEmpty():
        links = links.unionByName(materialize(confirmed(rest, texts, first_rows), "links"))
    # where the nearest members are none in full, as hashes of 32 bits were equal, all of their groups are tried
    refuted = opened.where("one").join(found(), ["a", "key"], "left_anti").select(
        F.col("group").alias("a"), F.col("a").alias("b"), F.lit(False).alias("one"), F.lit(True).alias("down")
    )
    refuted = materialize(refuted.distinct(), "refuted")
    if refuted.isEmpty():
        return links
    return links.unionByName(confirmed(opened_by(refuted), texts, first_rows))


def opened_groups(asked: DataFrame, groups: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of a query ``a`` and a member ``b`` of a group that may link, with ``group, one, near``, written down.

    ``asked(a, b, one)`` is written and names group ``a`` and query ``b``; ``one`` tells that one link to the group is enough. Members are as large as the query
    at least, but for queries with ``down``, if there is that column.
    """
    if "down" not in asked.columns:
        asked = asked.withColumn("down", F.lit(False))
    return materialize(dealt(asked, groups, sketches, "sketch").mapInArrow(open_batches, OPENED), "opened")


def confirmed(opened: DataFrame, texts: DataFrame, first_rows: DataFrame) -> DataFrame:
    """The written pairs(a, b) of sets that link."""
    opened = opened.select("a", "b")
    found = set_texts(both_sides(opened), texts, first_rows)
    return by_hub(opened, found.withColumnRenamed("set_id", "a"), found, "text").mapInArrow(linked_batches, "a long, b long")


def link(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of tokens link."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def grouped_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key and block; gives (set, least set of its group) for the sets of a block that links connect.

    A set is compared with the members of a group until it links to one, so a group of similar sets costs few
    comparisons for each of them.
    """
    shingler, place, groups, out = Shingler(), None, [], []

    def close() -> None:
        for group in groups:
            least = min(name for name, _ in group)
            out.extend((name, least) for name, _ in group if name != least)

    for rows in batches:
        for key, block, name, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if (key, block) != place:
                close()
                place, groups = (key, block), []
            tokens = shingler.tokens(text)
            if set_id(tokens) != name or any(name == other for g in groups for other, _ in g):
                continue
            met, rest = [(name, tokens)], []
            for group in groups:
                if any(link(tokens, there) for _, there in group):
                    met += group
                else:
                    rest.append(group)
            groups = [met, *rest]
        if out:
            yield arrow.batch(LINKS_ARROW, [list(c) for c in zip(*out, strict=True)])
            out.clear()
    close()
    if out:
        yield arrow.batch(LINKS_ARROW, [list(c) for c in zip(*out, strict=True)])


def keyed(sets: DataFrame) -> DataFrame:
    """``set_id, band, key, block`` of every set under each of its keys that others have too, written down."""
    keys = sets.where(F.col("keys").isNotNull()).select("set_id", F.posexplode("keys").alias("band", "key")).distinct()
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = sizes.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    return materialize(
        keys.join(sizes, "key").select("set_id", "band", "key", F.pmod(F.xxhash64("set_id"), "blocks").alias("block"), "blocks"), "keyed"
    )


def grouped(keys: DataFrame, texts: DataFrame, first_rows: DataFrame) -> DataFrame:
    """Links among sets with a common key, found in blocks of ``BLOCK`` sets; the least set of a key is in all its blocks."""
    split = keys.where(F.col("blocks") > 1).groupBy("key", "blocks").agg(F.min("set_id").alias("set_id"))
    shown = split.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "set_id")
    placed = materialize(keys.select("key", "block", "set_id").unionByName(shown.select("key", "block", "set_id")).distinct(), "placed")
    # similar sets have several keys in common: of blocks with the same sets, one is looked at
    members = [F.bit_xor(F.xxhash64(F.lit(k), "set_id")).alias(f"x{k}") for k in range(2)]
    blocks = placed.groupBy("key", "block").agg(F.count("*").alias("n"), *members).where("n > 1")
    blocks = blocks.groupBy("n", "x0", "x1").agg(F.min(F.struct("key", "block")).alias("first")).select("first.key", "first.block")
    placed = materialize(placed.join(blocks, ["key", "block"], "left_semi"), "distinct-blocks")
    # not written down: they lie by set already, as the join wants them
    found = one_text(placed.select("set_id").distinct(), texts, first_rows)
    ordered = placed.join(found, "set_id").select("key", "block", "set_id", "text").repartition("key", "block")
    return ordered.sortWithinPartitions("key", "block", "set_id").mapInArrow(grouped_batches, "a long, b long")


def group_members(sets: DataFrame, roots: DataFrame, keys: DataFrame) -> DataFrame:
    """The partition of all sets: ``set_id, n, root, group``, written down.

    Connected sets have a ``root`` and are cut into groups of about ``BLOCK``. Others are with those of their first key and
    block, all of which they have been compared with; a set alone under its key is a group of its own.
    """
    named = sets.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.max("n_shingles").alias("n"))
    known = named.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    parts = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    home = keys.where(F.col("band") == 0).select("set_id", "key", "block")
    known = known.join(parts, "root", "left").join(home, "set_id", "left")
    connected = F.xxhash64(F.lit("r"), "root", F.pmod(F.xxhash64("set_id"), "parts"))
    group = F.when(F.col("root").isNotNull(), connected).when(F.col("key").isNotNull(), F.xxhash64(F.lit("k"), "key", "block"))
    return materialize(known.select("set_id", "n", "root", F.coalesce(group, F.xxhash64(F.lit("s"), "set_id")).alias("group")), "groups")


def shared_tokens(sets: DataFrame) -> DataFrame:
    """``token, set_id, n, asked``: the first tokens of all sets, without those that one set alone has, written down.

    Tokens that the sample found often are known to be shared and stay where they are. Any other is in a few hundred sets at most,
    or the sample would have it, so its sets can be looked at together. ``asked`` is not 0 where a set asks for the token as a query: its first ninth,
    and a quarter as many after it as far as they are rare. It is the number of these that any set as large, or larger, has if it links.
    """
    n, whole = F.col("n_shingles"), 100 + PERCENT
    ninth = n - F.floor((2 * PERCENT * n + whole - 1) / F.lit(whole)) + 1
    more = F.greatest(F.lit(0), F.least("rare", ninth + F.floor(ninth / F.lit(4))) - ninth)
    tokens = sets.where(F.col("tokens").isNotNull()).select(
        "set_id", n.alias("n"), "rare", ninth.alias("ninth"), more.alias("more"), F.posexplode("tokens").alias("pos", "token")
    )
    asked = F.when(F.col("pos") < F.col("ninth") + F.col("more"), F.col("more") + 1).otherwise(0)
    # in one column: there is a row for nearly every token of the input
    columns = ["token", "set_id", (F.shiftleft("n", 28) + asked).alias("n_asked")]
    often = tokens.where(F.col("pos") >= F.col("rare")).select(*columns)
    same = W.partitionBy("token")
    rare = tokens.where(F.col("pos") < F.col("rare")).select(*columns)
    rare = rare.withColumn("low", F.min("set_id").over(same)).withColumn("high", F.max("set_id").over(same)).where("low <> high")
    # a set that several tasks met is there several times; rare tokens lie by token already, where this needs no other shuffle
    shared = rare.drop("low", "high").distinct().unionByName(often.distinct())
    n_asked = F.col("n_asked")
    shared = shared.select("token", "set_id", F.shiftright(n_asked, 28).alias("n"), n_asked.bitwiseAND(F.lit((1 << 28) - 1)).cast("int").alias("asked"))
    return materialize(shared, "shared")


def met_groups(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """``query, group, down``: sets and the groups with as many members as their own, or more, that may have a link for them.

    ``matrix(token, group)`` has one row however many members of a group have a token. Of a linked pair the smaller set asks with its first ninth, and what it
    asks for beyond is rare; the larger one has the token among its first fifth. The set that is sent may be the one or the other: ``down`` tells that
    members smaller than itself ask for it. Else they are at least as large. A token that many groups have is an
    ordinary hot key of the join: the sets that ask for it are few unless they link. Of the tokens that a linked pair has in common, those
    behind the first ones of the one or the other are the last in the order of all; so those they do have in common there are few less than the
    overlap, as in ``first_common``.
    """
    # sets that are alone, most of all, need not be looked up
    alone = F.xxhash64(F.lit("s"), "set_id")
    several = groups.where(F.col("group") != alone).select("set_id", "root", "group")
    several = several.join(several.groupBy("group").agg(F.count("*").alias("members")), "group").select("set_id", "root", "group", "members")
    listed = materialize(shared_tokens(sets).join(several, "set_id", "left"), "first-tokens")
    asks = F.col("members").isNotNull() & (F.col("asked") > 0)
    matrix = listed.groupBy("token", F.coalesce("group", alone).alias("group"), "root", "members").agg(
        F.min("n").alias("least"), F.max("n").alias("most"),
        F.min(F.when(asks, F.col("n"))).alias("ask_least"), F.max(F.when(asks, F.col("n"))).alias("ask_most"), F.min(F.when(asks, F.col("asked"))).alias("ask_few"),
    )
    matrix = materialize(matrix, "matrix")
    queries = listed.select(
        F.col("set_id").alias("query"), F.col("group").alias("own"), F.col("root").alias("own_root"), F.col("members").alias("own_members"), "n", "asked", "token"
    )
    own, own_members, members = F.coalesce("own", F.xxhash64(F.lit("s"), "query")), F.coalesce("own_members", F.lit(1)), F.coalesce("members", F.lit(1))
    apart = (own != F.col("group")) & ~F.coalesce(F.col("own_root") == F.col("root"), F.lit(False))
    n, most = F.col("n"), F.col("most")
    up = (F.col("asked") > 0) & (own_members <= members) & (most >= n) & (PERCENT * F.col("least") <= 100 * n)
    ask_least, ask_most = F.col("ask_least"), F.col("ask_most")
    down = F.coalesce((own_members < members) & (ask_least <= n) & (100 * ask_most >= PERCENT * n), F.lit(False))
    met = queries.join(matrix, "token").where(apart & (up | down)).groupBy("query", "group").agg(
        F.count_if(up).alias("up_common"), F.max("n").alias("n"), F.max("asked").alias("asked"), F.max("most").alias("most"),
        F.count_if(down).alias("down_common"), F.min(F.when(down, F.col("ask_few"))).alias("ask_few"), F.min(F.when(down, ask_least)).alias("ask_least"),
    )
    whole = 100 + PERCENT

    def fifth(small: Column, large: Column) -> Column:
        # a larger set has its first fifth only, which its overlap with the smaller one reaches the less the larger it is
        return F.floor(PERCENT * (100 * small - PERCENT * large) / F.lit(100 * whole)) + 1

    up = (F.col("up_common") > 0) & (F.col("up_common") >= F.least("asked", fifth(n, F.least(most, F.floor(100 * n / F.lit(PERCENT))))))
    smallest = F.greatest("ask_least", F.ceil(PERCENT * n / F.lit(100)))
    down = (F.col("down_common") > 0) & (F.col("down_common") >= F.least("ask_few", fifth(smallest, n)))
    return met.where(up | down).select("query", "group", F.coalesce(down, F.lit(False)).alias("down"))


def located(wanted: DataFrame, texts: DataFrame, first_rows: DataFrame) -> DataFrame:
    """``set_id, text`` of the wanted sets, from one row of each; a row that is there twice comes twice."""
    sources = materialize(first_rows.join(wanted, "set_id").select("set_id", "row"), "sources")
    return texts.join(sources, "row").select("set_id", "text")


def one_text(wanted: DataFrame, texts: DataFrame, first_rows: DataFrame) -> DataFrame:
    """One text for each of the wanted sets."""
    return located(wanted, texts, first_rows).groupBy("set_id").agg(F.min("text").alias("text"))


def set_texts(wanted: DataFrame, texts: DataFrame, first_rows: DataFrame) -> DataFrame:
    """One text for each of the wanted sets, written down."""
    return materialize(one_text(wanted, texts, first_rows), "set-texts")


def set_roots(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """``set_id, root`` of every set that has a link to another."""
    first_rows = materialize(
        sets.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("row").alias("row")), "set-rows"
    )
    keys = keyed(sets)
    roots = components(grouped(keys, texts, first_rows))
    groups = group_members(sets, roots, keys)
    met = materialize(met_groups(sets, groups), "met")
    links = linked(sharing(met, groups, sets), groups, texts, first_rows)
    # links between groups are contracted to their roots
    for side in "ab":
        root = roots.select(F.col("node").alias(side), "root")
        links = links.join(root, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    joined = components(links).select(F.col("node").alias("root"), F.col("root").alias("last"))
    known = roots.select(F.col("node").alias("set_id"), "root").unionByName(
        joined.join(roots, joined["root"] == roots["node"], "left_anti").select(F.col("root").alias("set_id"), "root")
    )
    return known.join(joined, "root", "left").select("set_id", F.coalesce("last", "root").alias("root"))


def classed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row, twin, doc_id, n_shingles, set_id, root`` of every row; rows without shingles have neither set nor root."""
    spark = arrow.prepared(docs.sparkSession)
    texts = identified(docs, key, text)
    frequent = spark.sparkContext.broadcast(frequent_tokens(texts.select("text")))
    sets = materialize(texts.mapInArrow(lambda it: set_batches(it, frequent), SETS), "sets")
    roots = materialize(set_roots(sets, texts.select("row", "text")), "set-roots")
    members = sets.select("row", "twin", "doc_id", "n_shingles", "set_id")
    # a set's rows may be a large share of all: the side with one row per set stays small beside them
    return members.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def row_names(docs: DataFrame, key: str, text: str) -> list[Column]:
    """Two 64-bit hashes that name a row together; ``row`` alone finds rows, and finds another one now and then."""
    key_, text_ = docs[key].cast("long"), docs[text].cast("string").cast("binary")
    return [F.xxhash64(key_, text_), F.xxhash64(F.lit("twin"), text_, key_)]


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    row, twin = row_names(docs, key, text)
    return docs.select(
        row.alias("row"), twin.alias("twin"), docs[key].cast("long").alias("doc_id"), docs[text].cast("string").cast("binary").alias("text")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's class under links of Jaccard ``PERCENT`` / 100 or more: ``doc_id, n_shingles, component_id``.

    Words are runs without ASCII white space, A-Z lowered; a document is the set of its five-word shingles, with fewer
    words its whole sequence. ``component_id`` is the smallest doc_id that links lead to. Missing and empty texts have
    no shingles and are their own class. One row comes out per row that goes in: repeated rows are in one class,
    rows without a key take part and have the smallest key of their class, if it has one. Every link between different
    sets is found or implied by others; shingles and sets are named by 64-bit hashes. Whole texts
    of any length are read; a text is held by one task at a time. An empty table gives an empty one. Only key and text
    are read.
    """
    members = materialize(classed(docs, key, text), "members")
    classes = members.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return members.join(classes, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that of the smallest key, with all its columns; documents without shingles all stay.

    A class without keys keeps one of its rows. Rows that repeat key and text are one document.
    """
    members = materialize(classed(docs, key, text), "members")
    # a row without shingles is a class of its own
    alone = F.when(F.col("root").isNull(), F.struct("row", "twin"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "twin")
    first = members.groupBy("root", alone.alias("alone")).agg(F.min(order).alias("first")).select("first.row", "first.twin").distinct()
    names = []
    for name in ("_row", "_twin"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    named = docs.withColumns(dict(zip(names, row_names(docs, key, text), strict=True)))
    kept = named.join(first.select(F.col("row").alias(names[0]), F.col("twin").alias(names[1])), names, "left_semi")
    return kept.dropDuplicates(names).select(*docs.columns)
