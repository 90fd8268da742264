"""Token counts, record files, packing and the codec against the tokenizers library."""

import bisect
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablesieve.llm import bpe, encoding, packing, records, token_counts
from tablesieve.llm.arrow import chunks

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    None, "", " ", "\n\n  \t", "it's we'll 'S 12,345 ½²", "a" * 5000, "x y " * 60_000, "end<|endoftext|>of <|startoftext|>text",
    "ÀÉÎ straße ΣΑΣ İstanbul", "日本語 テキスト", "a՘b Ᲊ c", "🙂🙂 ok", "tail  \n", "same", "same", "\x1c\x85 z",
]
SCHEMA = "doc_id long, text string, length string, n_tokens string, start string"


def table(spark, texts=ODD):
    rows = [(i if i != 3 else None, t, "a", "b", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def library(path, text):
    return encoding.library_tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_chunks_keep_tokens():
    text = "a  b\n c d " * 400 + "word" * 900
    assert "".join(chunks(text, 50)) == text and len(list(chunks(text, 50))) > 20
    assert [i for c in chunks(text, 50) for i in library(BYTE, c)] == library(BYTE, text)
    assert list(chunks("", 5)) == [""]


def test_ids_are_the_librarys():
    found = encoding.Encoder(BYTE).ids(ODD)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library(BYTE, t) for t in ODD]
    assert [np.frombuffer(f, "<u2").tolist() for f in encoding.Encoder(BYTE, 2).ids(ODD)] == [library(BYTE, t) for t in ODD]


def test_other_tokenizers_go_through_the_library():
    other = encoding.Encoder(WORD)
    assert not other.by_piece
    assert [np.frombuffer(f, "<u4").tolist() for f in other.ids(ODD)] == [library(WORD, t) for t in ODD]


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_PIECES", 3)
    small = encoding.Encoder(BYTE)
    texts = ["one two three four five", "six seven one two"]
    for text in texts:
        assert np.frombuffer(small.ids([text])[0], "<u4").tolist() == library(BYTE, text)
        assert len(small.kept) <= 5


def test_new_pieces_are_given_together_and_in_bounded_calls():
    """Pieces that open with a space share texts, no call holds many, and every piece keeps the ids it has alone."""

    class Counting:
        def __init__(self, inner):
            self.inner, self.calls = inner, []

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **kw):
            self.calls.append(len(texts))
            return self.inner.encode_batch_fast(texts, **kw)

    fresh = encoding.Encoder(BYTE)
    fresh.library = counting = Counting(fresh.library)
    named = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    texts = [" ".join(f"w{named(i)}x \u00e9{named(i)} z\u3000{named(i)} it's ({i})" for i in range(n, n + 900)) + "\n  end" for n in (0, 900, 1800)]
    assert [np.frombuffer(f, "<u4").tolist() for f in fresh.ids(texts)] == [library(BYTE, t) for t in texts]
    assert max(counting.calls) <= 256 and sum(counting.calls) < 0.6 * len(fresh.kept)
    assert all(np.frombuffer(ids, "<u4").tolist() == library(BYTE, p) for p, ids in list(fresh.kept.items())[::37])


@pytest.mark.parametrize("path", [BYTE, PIECE])
def test_counts(spark, path):
    rows = token_counts.count_tokens(table(spark), path, 100).collect()
    if path == PIECE:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t or "")) for t in ODD]
    else:
        want = [len(library(path, t)) for t in ODD]
    assert [r.n_tokens for r in rows] == want
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in ODD]
    assert [r.over_limit for r in rows] == [n > 100 for n in want]
    assert token_counts.count_tokens(table(spark, []), path, 100).count() == 0


def test_records_round_trip(spark, tmp_path):
    docs, uri = table(spark).repartition(3), f"file://{tmp_path}/records"
    assert records.write_ids(docs, BYTE, 0, uri).agg(F.sum("records")).first()[0] == len(ODD)
    want, start = [], 0
    order = sorted(range(len(ODD)), key=lambda i: (-1 if i == 3 else i))
    for i in order:
        ids = np.array([*library(BYTE, ODD[i]), 0], "<u4")
        want.append((None if i == 3 else i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, records.summary(spark, uri).collect()), key=lambda r: r[1]) == want
    shuffled = records.read_ids(spark, uri, seed=5)
    plain = records.read_ids(spark, uri)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, plain.collect()))


def test_records_empty_table_and_damage(spark, tmp_path):
    uri = f"file://{tmp_path}/none"
    records.write_ids(table(spark, []), BYTE, 0, uri)
    assert records.summary(spark, uri).count() == 0
    writer = records.Writer(f"file:{tmp_path}", 0, 4)
    writer.add(7, np.array([1, 2], "<u4").tobytes())
    writer.close()
    path = tmp_path / f"{writer.done[0][2]}.rec"
    data = bytearray(path.read_bytes())
    assert records.payload_at(memoryview(data), 0)[-8:] == np.array([1, 2], "<u4").tobytes()
    data[-6] ^= 1
    for part in (data, data[:-2], data[:5], data[:-12]):
        with pytest.raises(records.DamagedRecord):
            records.payload_at(memoryview(part), 0)


def test_a_path_without_store_is_refused(tmp_path):
    with pytest.raises(ValueError, match="names no store"):
        records.store(str(tmp_path))


def test_many_rows_of_one_key(spark, tmp_path):
    rows = [(3 if i % 3 else None, f"text {i}") for i in range(300)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, named string, part string")
    uri = f"file://{tmp_path}/hot"
    records.write_ids(docs, BYTE, 0, uri)
    found = sorted(records.summary(spark, uri).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 100 + [3] * 200
    tokenizer = encoding.library_tokenizer(BYTE)
    assert found[-1].start + found[-1].n_tokens == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:], strict=False))


def test_files_roll(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 64)
    writer = records.Writer(f"file://{tmp_path}", 3, 4)
    for key in range(10):
        writer.add(key, np.arange(8, dtype="<u4").tobytes())
    writer.close()
    assert len(writer.done) > 4 and sum(d[3] for d in writer.done) == 10


def test_codec_is_the_librarys(spark):
    code, tokenizer = bpe.Codec(WORD), encoding.library_tokenizer(WORD)
    for text in ODD:
        ids = np.frombuffer(code.encode(text or ""), "<u4").tolist()
        assert ids == library(WORD, text), text
        assert code.decode(np.array(ids, "<u4").tobytes()) == tokenizer.decode(ids, skip_special_tokens=False)
    rows = bpe.roundtrip(table(spark), WORD).collect()
    for row, text in zip(rows, ODD, strict=True):
        ids = library(WORD, text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(table(spark), WORD), WORD).collect()
    assert [r.text for r in back] == [tokenizer.decode(library(WORD, t), skip_special_tokens=False) for t in ODD]
    assert bpe.roundtrip(table(spark, []), WORD).count() == 0


def test_merges_against_rescanning():
    """The queue gives what merging the best pair of a fresh scan each time gives."""
    code = bpe.Codec(WORD).bpe
    draw = random.Random(4)
    for _ in range(300):
        word = "".join(draw.choice("abehinorst") for _ in range(draw.randint(1, 30)))
        symbols = code.symbols(word)
        while True:
            ranked = [(code.merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in code.merges]
            if not ranked:
                break
            at = min(ranked)[1]
            symbols[at : at + 2] = [code.merges[symbols[at], symbols[at + 1]][1]]
        assert code.word(word) == symbols


def sequential(lengths, capacity):
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        opened += at == len(gaps)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        if gap - length:
            bisect.insort(gaps, gap - length)
    return opened


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) == sequential([r.length for r in rows], capacity)


@pytest.mark.parametrize("seed", range(6))
def test_sweep_is_best_fit(spark, seed):
    draw, capacity = random.Random(seed), 64
    lengths = [draw.choice([1, 2, 3, 30, 33, draw.randint(1, 64)]) for _ in range(draw.randint(0, 1500))]
    items = spark.createDataFrame([(i // 2, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(items, capacity, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted((i // 2, n) for i, n in enumerate(lengths))
    check_packed(rows, capacity)


def test_pack_documents(spark):
    rows = packing.pack_documents(table(spark), BYTE, 2, 1024).collect()
    check_packed(rows, 1024)
    for i, text in enumerate(ODD):
        ids = [*library(BYTE, text), 2]
        own = sorted((r for r in rows if r.doc_id == (None if i == 3 else i)), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == 1 or all(r.length == 1024 for r in own[1:])
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
    assert packing.pack_documents(table(spark, []), BYTE, 2, 1024).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(40)], "doc_id long, text string")
    pieces = packing.token_pieces(docs, BYTE, 2, 32, with_ids=True)
    packed = packing.pack(pieces.drop("ids"), 32, ["doc_id", "piece", "start", "ids_crc32"])
    found = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(packed, pieces).collect()}
    for r in packed.collect():
        part = found[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def test_lengths_outside_the_capacity(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 9)], "doc_id long, length long"), 8, ["doc_id"])
