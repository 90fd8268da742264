"""Small helpers around Arrow functions: session settings, batches of bounded size, text pieces."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tablesieve.runtime import tune

# An Arrow batch is held whole by a Python worker, so its rows and its bytes are both limited.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

CHUNK_CHARS = 1 << 18

# one space between two characters that are not white space: no token of the byte-level split spans it
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings and bounded Arrow batches.

    Workers on the driver's machine find the library where the driver does; others need it installed or in --py-files.
    """
    tune(spark)
    known = spark.sparkContext.environment
    if HOME not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), HOME]))
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut before single spaces only.

    The tokens of the parts in order are the tokens of the text. A text without such a space
    stays in one part; the empty text is one empty part.
    """
    at = 0
    while len(text) - at > size:
        found = BOUNDARY.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch of plain lists or arrays, in the order of ``schema``."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def kept_rows(docs: DataFrame, text: str, passes: Callable[[list[bytes | None]], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns and whatever their names.

    ``passes`` sees the texts of a batch in UTF-8. Rows are judged where they are: nothing is joined or shuffled.
    """
    place = docs.columns.index(text)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(place).cast(pa.binary()).to_pylist()
            yield rows.filter(pa.array(passes(texts), pa.bool_()))

    return docs.mapInArrow(filtered, docs.schema)
