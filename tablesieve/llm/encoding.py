"""Token ids of whole texts, as the tokenizers library gives them, at the speed of a look-up.

The library spends most of its time on bookkeeping around the merges. A byte-level tokenizer encodes
each piece of its split on its own, so every distinct piece is given to the library once per worker and its
ids are kept; a text's ids are its pieces' ids one after the other. Characters whose class the split of the
library and the one here see differently are found by asking the library about each new character; texts that
hold one, and tokenizers of another kind, go through the library whole.
"""

from __future__ import annotations

import functools
import json
import operator
import os
import re
from itertools import compress

import numpy as np

from tablesieve.llm.arrow import chunks

# Fixed value: the split of byte-level tokenizers, in the classes of the re module, which is the fastest here. It takes
# numerals that are no digits for letters; such characters disagree with the library and are left to it.
SPACES = r" \t\n\r\f\v\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^{SPACES}\w]|_)+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

TOGETHER_CHARS = 1 << 20
KEPT_PIECES = 1_000_000
KEPT_LENGTH = 64
#: A text costs the library more than the merges of a piece do, so pieces share texts; a call holds what it makes of all its texts.
JOINED_PIECES = 256
CALL_TEXTS = 256


def library_tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding, one thread per call."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Specials:
    """Added tokens of a tokenizer file, cut out of texts before anything else."""

    def __init__(self, spec: dict):
        self.ids = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        names = sorted(self.ids, key=len, reverse=True)
        self.pattern = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.names = names

    def parts(self, text: str) -> list[str]:
        """Plain and added parts of ``text`` in order; plain parts may be empty."""
        if any(name in text for name in self.names):
            return self.pattern.split(text)
        return [text]


class Agreement:
    """Remembers for which characters the library's split is ours."""

    def __init__(self, probe):
        self.probe, self.good, self.bad = probe, set(map(chr, range(128))), set()

    def holds(self, text: str) -> bool:
        if text.isascii():
            return True
        found = set(text)
        for char in found - self.good - self.bad:
            (self.good if self.probe(char) else self.bad).add(char)
        return found.isdisjoint(self.bad)


class Encoder:
    """``ids(texts)``: little-endian unsigned ids of each text, without added begin and end tokens.

    ``width`` is 4, or 2 where every id fits. At most ``KEPT_PIECES`` pieces are kept; when there are
    more, keeping starts anew.
    """

    def __init__(self, path: str, width: int = 4):
        self.library = library_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        plain = [
            spec.get("normalizer") is None,
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"),
            not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]),
        ]
        self.by_piece = all(plain)
        self.dtype = np.dtype(f"<u{width}")
        self.specials = Specials(spec)
        self.findall = re.compile(SPLIT).findall
        self.agreement = Agreement(self._same_split)
        self.kept: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        # a space is written so by byte-level tokenizers
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.joins = self.by_piece and not any(" " in name for name in self.specials.names)

    def _same_split(self, char: str) -> bool:
        probe = f"a{char}b1{char} {char}."
        return [probe[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(probe)] == self.findall(probe)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text as the library gives them, some at a time: what it makes of a text is held until the call ends."""
        out: list[list[int]] = []
        for at in range(0, len(texts), CALL_TEXTS):
            found = self.library.encode_batch_fast(texts[at : at + CALL_TEXTS], add_special_tokens=False)
            out.extend(e.ids for e in found)
        return out

    def _joined(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that have one space, at their start, encoded as texts of many pieces.

        The split cuts before each of those spaces, so a piece's ids go from one token that opens with a space to the next.
        """
        runs = [pieces[at : at + JOINED_PIECES] for at in range(0, len(pieces), JOINED_PIECES)]
        out: dict[str, bytes] = {}
        for run, found in zip(runs, self._encoded(["".join(run) for run in runs]), strict=True):
            starts = np.flatnonzero(self.opens[found]).tolist()
            if len(starts) != len(run) or starts[0]:
                out.update((p, self._packed(ids)) for p, ids in zip(run, self._encoded(run), strict=True))
                continue
            data, width = self._packed(found), self.dtype.itemsize
            ends = [*starts[1:], len(found)]
            out.update((p, data[a * width : b * width]) for p, a, b in zip(run, starts, ends, strict=True))
        return out

    def _look_up(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of new pieces, which are kept; those of long pieces are only handed on."""
        if len(self.kept) + len(pieces) > KEPT_PIECES:
            self.kept.clear()
        joined = [p for p in pieces if p[0] == " " and p[1:2].strip()] if self.joins else []
        packed = self._joined(joined)
        rest = [p for p in pieces if p not in packed]
        packed.update((p, self._packed(ids)) for p, ids in zip(rest, self._encoded(rest), strict=True))
        self.kept.update((p, ids) for p, ids in packed.items() if len(p) <= KEPT_LENGTH)
        return packed

    def _pieces(self, parts: list[str]) -> list[bytes]:
        """Ids of plain parts of bounded size altogether."""
        known, out, new = self.kept.__getitem__, [], set()
        for part in parts:
            pieces = self.findall(part)
            try:
                out.append(b"".join(map(known, pieces)))
            except KeyError:
                # what is known is held, as the look-up may let go of it; no piece is without ids
                ids = list(map(self.kept.get, pieces))
                new.update(compress(pieces, map(operator.not_, ids)))
                out.append((pieces, ids))
        found = self._look_up(new) if new else {}
        for place, held in enumerate(out):
            if not isinstance(held, bytes):
                out[place] = b"".join([ids or found[p] for p, ids in zip(*held, strict=True)])
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a missing text counts as empty."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts, owners, size = [], [], 0

        def flush() -> None:
            for owner, ids in zip(owners, self._pieces(parts), strict=True):
                out[owner][out[owner].index(b"")] = ids

        for owner, text in enumerate(texts):
            if not text:
                continue
            if not self.by_piece or not self.agreement.holds(text):
                out[owner].append(self._packed(self.library.encode(text, add_special_tokens=False).ids))
                continue
            for part in self.specials.parts(text):
                if part in self.specials.ids:
                    out[owner].append(self._packed([self.specials.ids[part]]))
                    continue
                for chunk in filter(None, chunks(part)):
                    # an open place, filled in order
                    out[owner].append(b"")
                    parts.append(chunk)
                    owners.append(owner)
                    size += len(chunk)
                    if size >= TOGETHER_CHARS:
                        flush()
                        parts, owners, size = [], [], 0
        flush()
        return [b"".join(ids) for ids in out]


@functools.cache
def encoder(path: str, width: int = 4) -> Encoder:
    """The worker's encoder of a file: its pieces are kept from task to task."""
    return Encoder(path, width)
