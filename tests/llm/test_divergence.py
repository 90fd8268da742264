"""Divergence of sources against plain counting, with copies, hot groups and odd rows."""

import re
from collections import Counter, defaultdict

import pytest

from tablesieve.llm import divergence

SCHEMA = "lang string, text string, source string, term string, count string, digest string, no string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, least=30):
    rows = [(lang or "", text or "", source or "") for lang, text, source in rows]
    groups, found, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for lang, text, source in rows:
        groups[lang].add(source)
        terms = TERM.findall(text.translate(LOWER))
        found[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in found[lang].items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            marks = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", marks, 50)):
                for rank, (value, item) in enumerate(sorted(values, key=lambda v: (-v[0], v[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def audited(spark, rows):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    return sorted(map(tuple, divergence.audit(frame).collect()))


def texts(n, words, source=lambda i: f"s{i % 4}"):
    return [("en", " ".join(f"W{chr(97 + (i * j) % words)}É" for j in range(1, 9)), source(i)) for i in range(n)]


def test_copies_and_hot_sources(spark):
    rows = texts(200, 20) + [("en", "Same words, same words", "hot")] * 300 + [("de", "Same words", f"s{i % 3}") for i in range(90)]
    assert audited(spark, rows) == expected(rows)


def test_more_terms_than_reported(spark):
    rows = [("en", " ".join(chr(97 + i % 26) + chr(97 + k % 26) * (1 + k // 26) for k in range(90)), f"s{i % 5}") for i in range(400)]
    assert audited(spark, rows) == expected(rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_COUNTS", 16)
    monkeypatch.setattr(divergence, "SLICE_CELLS", 8)
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    rows = texts(300, 26)
    assert audited(spark, rows) == expected(rows)


@pytest.mark.parametrize("rows", [
    [],
    [(None, None, None)] * 40,
    [("en", "once", "a"), ("en", "", "b"), (None, "x " * 50_000, None), (None, "X", "")] * 2,
    [("en", "kept", "a")] * 30 + [("en", "", "b"), ("en", "123 _", "c"), ("fr", "kept", "a")],
])
def test_odd_rows(spark, rows):
    assert audited(spark, rows) == expected(rows)


def test_a_text_is_tokenised_once(spark):
    rows = [("en", "same text", f"s{i % 3}") for i in range(50)] + [("de", "same text", "s0")]
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    left = divergence.collapsed(frame).collect()
    assert sorted((r.lang, sum(s.copies for s in r.sources)) for r in left) == [("de", 1), ("en", 50)]
