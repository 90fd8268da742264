"""Shards: gapless, of equal size and of one mixture, whatever the rows."""

import zlib
from collections import Counter

import pytest

from tablesieve.llm.sharding import shard, write_shards

SCHEMA = "doc_id long, text string, source string, shard string, slot string, place string, bucket string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def check(rows, count, shards):
    assert len(rows) == count
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values(), default=0) - min([sizes.get(k, 0) for k in range(shards)]) <= 1
    for k in sizes:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


def test_mixture_of_a_hot_source(spark):
    data = [(i, f"text {i % 50}", "hot" if i % 3 else f"s{i % 40}") for i in range(3000)]
    rows = shard(docs(spark, data), 7).collect()
    check(rows, 3000, 7)
    for source, n in Counter(s for _, _, s in data).items():
        per = Counter(r.shard for r in rows if r.stratum == f"s{source}")
        assert all(abs(per[k] - n / 7) <= 2 + 3 * (n / 7 > 50) for k in range(7)), source


def test_same_rows_same_shards(spark):
    data = [(i, f"t{i}", f"s{i % 5}") for i in range(500)]
    a = sorted(map(tuple, shard(docs(spark, data), 4).collect()))
    b = sorted(map(tuple, shard(docs(spark, data[::-1]).repartition(5), 4).collect()))
    assert a == b
    assert a != sorted(map(tuple, shard(docs(spark, data), 4, seed=18).collect()))


def test_one_row_sources_are_spread(spark):
    rows = shard(docs(spark, [(i, "t", f"own{i}") for i in range(400)]), 8).collect()
    check(rows, 400, 8)


@pytest.mark.parametrize("count", [0, 3])
def test_odd_rows(spark, count):
    data = [(None, None, None), (None, "", ""), (1, "é" * 50_000, "a"), (1, "é" * 50_000, "a"), (2, "x", None)] * count
    rows = shard(docs(spark, data), 4).collect()
    check(rows, 5 * count, 4)
    if rows:
        assert {r.size for r in rows} == {16, 100_016, 17}
        assert {r.text_crc32 for r in rows} == {0, zlib.crc32(("é" * 50_000).encode()), zlib.crc32(b"x")}


def test_written_shards(spark, tmp_path):
    source = docs(spark, [(i, f"t{i}", f"s{i % 3}") for i in range(100)])
    write_shards(source, shard(source, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(i, f"t{i}") for i in range(100)]
