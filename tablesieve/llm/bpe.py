"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked list of symbols.

The whole way from text to ids is done here for tokenizers that lower-case, split into words and mark word ends:
added tokens are cut out, the rest is normalised and split, a word's bytes become symbols and merges are applied in
the order of their ranks. Decoding concatenates vocabulary strings, set apart by a space as the library does for
files without a decoder.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablesieve.llm import arrow
from tablesieve.llm.encoding import KEPT_LENGTH, KEPT_PIECES, Agreement, Specials, library_tokenizer

# Fixed value: the split of the word tokenizer; what lies between its matches is dropped.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

CHUNK_CHARS = 1 << 18
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBPE:
    """Merges of one tokenizer file: ``word(text) -> ids`` and the vocabulary for decoding."""

    def __init__(self, model: dict):
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        ids = self.vocabulary
        #: (left id, right id) -> (rank, merged id)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}

    def symbols(self, word: str) -> list[int]:
        letters = [self.letters[b] for b in word.encode("utf-8")]
        letters[-1] += self.end
        return [self.vocabulary[x] for x in letters]

    def word(self, word: str) -> list[int]:
        """Ids of one word. Ties of rank are merged from left to right."""
        symbol = self.symbols(word)
        size = len(symbol)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        merges, queue = self.merges, []
        for at in range(size - 1):
            found = merges.get((symbol[at], symbol[at + 1]))
            if found:
                queue.append((found[0], at, symbol[at], symbol[at + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, left, right, merged = heapq.heappop(queue)
            following = after[at]
            # an entry is stale once either of its symbols has been merged away
            if symbol[at] != left or following >= size or symbol[following] != right:
                continue
            symbol[at], symbol[following] = merged, -1
            after[at] = following = after[following]
            if following < size:
                before[following] = at
                found = merges.get((merged, symbol[following]))
                if found:
                    heapq.heappush(queue, (found[0], at, merged, symbol[following], found[1]))
            previous = before[at]
            if previous >= 0:
                found = merges.get((symbol[previous], merged))
                if found:
                    heapq.heappush(queue, (found[0], previous, symbol[previous], merged, found[1]))
        return [s for s in symbol if s >= 0]


class Codec:
    """``encode(text)`` gives little-endian unsigned 32-bit ids, ``decode(ids)`` the text they stand for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") is not None:
            raise ValueError(f"{path} is not a word tokenizer that lower-cases")
        self.bpe = WordBPE(spec["model"])
        self.specials = Specials(spec)
        names = {i: t for t, i in self.bpe.vocabulary.items()} | {i: t for t, i in self.specials.ids.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.findall = regex.compile(SPLIT).findall
        self.library = library_tokenizer(path)
        self.agreement = Agreement(self._same_split)
        self.kept: dict[str, bytes] = {}

    def _normal(self, text: str) -> str:
        """NFC and lower case of each character by itself, so a final sigma is an ordinary one.

        White space is not rewritten, as the split drops it anyway.
        """
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _asked(self, text: str) -> list[str]:
        """Words as the library splits them, for characters newer than the tables here."""
        decode = {letter: byte for byte, letter in enumerate(self.bpe.letters)}
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(decode[c] for c in letters).decode("utf-8") for letters, _ in parts]

    def _same_split(self, char: str) -> bool:
        probe = f"a{char}b1{char} {char}."
        return self._asked(probe) == self.findall(self._normal(probe))

    def _words(self, words: list[str]) -> bytes:
        kept, extra = self.kept, {}
        new = set(words).difference(kept)
        if len(kept) + len(new) > KEPT_PIECES:
            kept.clear()
            new = set(words)
        for word in new:
            packed = np.array(self.bpe.word(word), "<u4").tobytes()
            (kept if len(word) <= KEPT_LENGTH else extra)[word] = packed
        if extra:
            return b"".join([kept[w] if w in kept else extra[w] for w in words])
        return b"".join(map(kept.__getitem__, words))

    def encode(self, text: str) -> bytes:
        out = []
        ours = self.agreement.holds(text)
        for part in self.specials.parts(text):
            if part in self.specials.ids:
                out.append(np.array([self.specials.ids[part]], "<u4").tobytes())
            elif ours:
                # a space ends a word for good, so long texts are taken in parts
                out.extend(self._words(self.findall(self._normal(c))) for c in arrow.chunks(part, CHUNK_CHARS))
            else:
                out.append(self._words(self._asked(part)))
        return b"".join(out)

    def decoded(self, ids: bytes) -> Iterator[bytes]:
        """UTF-8 of the decoded text, in parts of bounded size."""
        numbers, step = np.frombuffer(ids, "<u4"), 1 << 16
        for start in range(0, len(numbers), step):
            words = " ".join(map(self.names.__getitem__, numbers[start : start + step].tolist()))
            yield (" " + words if start else words).encode("utf-8")

    def decode(self, ids: bytes) -> str:
        return b"".join(self.decoded(ids)).decode("utf-8")


@functools.cache
def codec(path: str) -> Codec:
    """The worker's codec of a file: words it has met are kept from task to task."""
    return Codec(path)


def roundtrip_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    code = codec(path)
    for rows in batches:
        counts, packed, decoded = [], [], []
        for text in rows.column(1).to_pylist():
            ids = code.encode(text or "")
            back = hashlib.sha256()
            for part in code.decoded(ids):
                back.update(part)
            counts.append(len(ids) // 4)
            packed.append(hashlib.sha256(ids).hexdigest())
            decoded.append(back.hexdigest())
        yield arrow.batch(SCHEMA, [rows.column(0), counts, packed, decoded])


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    code = codec(path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    for rows in batches:
        ids = [np.frombuffer(code.encode(t or ""), "<u4").astype("i8") for t in rows.column(1).to_pylist()]
        yield arrow.batch(schema, [rows.column(0), ids])


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    code = codec(path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    for rows in batches:
        texts = [code.decode(np.array(ids or [], "<u4").tobytes()) for ids in rows.column(1).to_pylist()]
        yield arrow.batch(schema, [rows.column(0), texts])


def _keyed(df: DataFrame, key: str, value: str, kind: str) -> DataFrame:
    arrow.prepared(df.sparkSession)
    return df.select(df[key].cast("long").alias("doc_id"), df[value].cast(kind).alias("value"))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text: ``doc_id, ids``. A missing or empty text has no ids."""
    return _keyed(docs, key, text, "string").mapInArrow(lambda it: encode_batches(it, path), "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Text of each row's ids, special tokens included: ``doc_id, text``. No ids give the empty text."""
    return _keyed(encoded, key, ids, "array<long>").mapInArrow(
        lambda it: decode_batches(it, path), "doc_id long, text string"
    )


def roundtrip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    One row comes out per row that goes in, nothing is shuffled; other columns are not read, missing
    keys stay missing, repeated rows are repeated, an empty table gives an empty one. Texts of any length are
    taken in parts; what a worker keeps of words is bounded.
    """
    return _keyed(docs, key, text, "string").mapInArrow(
        lambda it: roundtrip_batches(it, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
