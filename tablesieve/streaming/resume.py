"""Resumable runs: questions are worked off once, as files of them arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_pending(
    spark: SparkSession,
    source: str,
    schema,
    work: Callable[[DataFrame], DataFrame],
    target: str,
    state: str,
    files_per_batch: int = 100,
    key: str | None = None,
) -> StreamingQuery:
    """Apply ``work`` to the parquet question files in ``source`` that ``state`` does not know as done.

    Each batch of files is written as JSON lines to its own folder ``target/run_seq=<batch>``, replaced
    when a broken batch is run again, so every question has one record. Ends when no file is left;
    a later call goes on from there. ``state`` must be on shared storage.

    With ``key``, a question that arrives again, in the same files or in later ones, is worked once: the keys seen are kept as the
    stream's state, partitioned by key, and survive with it from call to call. Which of several rows of a new key is taken is open.
    """

    def step(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").json(f"{target}/run_seq={number}")

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if key is not None:
        arriving = arriving.dropDuplicates([key])
    return (
        arriving.writeStream.foreachBatch(step)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
