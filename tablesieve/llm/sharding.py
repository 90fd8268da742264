"""Shards that all hold the same mixture of sources, by proportional stratified interleaving.

Rows of a source are put in a seeded random order; the row at place r of n gets the fraction (r + phase) / n, where the
phase is a seeded number in [0, 1) for the source. Sorted by fraction, the sources are interleaved in
proportion everywhere, and cutting that order into equal runs gives every shard the mixture of the whole to about a row
per source and side of the cut. Shards differ by one row at most (the law ``rows``). DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesieve.llm.ranking import bucket_count, numbered
from tablesieve.runtime import materialize, tune

SEED = 17
ROW_BYTES = 16
UNIT = float(1 << 48)


def unit_number(*parts: Column, seed: int = SEED) -> Column:
    """A seeded number in [0, 1) with 48 random bits, from the MD5 of the parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(UNIT)


def bucketed(unit: Column, buckets: int) -> Column:
    return F.floor(unit * F.lit(float(buckets))).cast("long")


def described(docs: DataFrame, key: str, text: str, stratum: str) -> DataFrame:
    """What sharding needs of each row; the text itself is read once and goes no further."""
    body = docs[text].cast("string")
    return docs.select(
        docs[key].cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), docs[stratum].cast("string")), F.lit("")).alias("stratum"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + F.lit(ROW_BYTES)).alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
    )


def interleave(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``position``, gapless from 0: the place of each row in the interleaved order of all rows.

    ``rows`` has ``doc_id, stratum, size, text_crc32``. Rows equal in all of these are interchangeable.
    """
    order = ["u", "doc_id", "text_crc32", "size"]
    rows = materialize(rows.withColumn("u", unit_number(F.col("doc_id"), F.col("text_crc32"), seed=seed)), "shard-rows")
    buckets = bucket_count(rows.count())
    drawn = rows.withColumn("bucket", bucketed(F.col("u"), buckets))
    ranked = numbered(drawn, ["stratum"], "bucket", order)
    fraction = (F.col("place") + unit_number(F.col("stratum"), seed=seed)) / F.col("total")
    mixed = ranked.withColumn("fraction", fraction).drop("place", "total", "bucket")
    mixed = materialize(mixed.withColumn("bucket", bucketed(F.col("fraction"), buckets)), "shard-mixed")
    placed = numbered(mixed.withColumn("_all", F.lit(0)), ["_all"], "bucket", ["fraction", "stratum", *order])
    return placed.withColumnRenamed("place", "position").drop("_all", "bucket")


def shard(
    docs: DataFrame, shards: int, seed: int = SEED, key: str = "doc_id", text: str = "text", stratum: str = "source"
) -> DataFrame:
    """``doc_id, stratum, size, text_crc32, shard, slot`` for every row; slots are gapless from 0 in each shard.

    The result depends on the rows and the seed only, not on their files or order. A missing stratum is a stratum of its
    own; a missing text has no bytes and the checksum of none; missing keys share one place in the
    shuffle and are told apart by text; repeated rows each get a slot; an empty table gives an empty
    one; with fewer rows than shards some shards are empty. Only key, text and stratum are read. Copies of
    a text are spread like any rows: the law is ``rows``, so groups are not kept together.
    """
    tune(docs.sparkSession)
    placed = interleave(described(docs, key, text, stratum), seed)
    number = F.expr(f"(position * {int(shards)}) div total")
    start = F.expr(f"(shard * total + {int(shards) - 1}) div {int(shards)}")
    return placed.withColumn("shard", number.cast("int")).select(
        "doc_id", F.nullif(F.col("stratum"), F.lit("")).alias("stratum"), "size", "text_crc32", "shard",
        (F.col("position") - start).cast("long").alias("slot"),
    )


RUN_ROWS = 100_000


def write_shards(docs: DataFrame, placed: DataFrame, uri: str, key: str = "doc_id", text: str = "text") -> None:
    """Write ``doc_id, text, stratum, slot`` as Parquet, one folder per shard, in files of ``RUN_ROWS`` slots.

    ``placed`` is what ``shard`` gave for ``docs``; keys must be unique.
    """
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = placed.select("doc_id", "stratum", "shard", "slot").join(texts, "doc_id")
    run = F.floor(F.col("slot") / RUN_ROWS)
    rows.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(uri)
