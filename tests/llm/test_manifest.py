"""Merkle manifest: every digest against a plain tree, over blocks and languages of odd sizes."""

import hashlib
import zlib

import pytest

from tablesieve.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos string, size string, digest string"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def folded(tree, at, digest):
    """Root, sibling text and root with another digest, of one node among the lowest of ``tree``."""
    proof = ""
    for nodes in tree[:-1]:
        run = nodes[at - at % 8 : at - at % 8 + 8]
        before, after = run[: at % 8], run[at % 8 + 1 :]
        proof += "".join(before + after)
        digest = H(*before, digest, *after)
        at //= 8
    return tree[-1][0], proof, digest


def expected(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {n: sorted(by_lang[n], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for n in names}
    trees = [levels([leaf(r) for r in ordered[n]]) for n in names]
    top = levels([tree[-1][0] for tree in trees]) if trees else []
    out = []
    for place, name in enumerate(names):
        leaves = trees[place]
        for at, row in enumerate(ordered[name]):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].translate(UPPER))
            subroot, proof, digest = folded(leaves, at, leaf(changed))
            root, higher, digest = folded(top, place, digest)
            out.append((row[0], leaves[0][at], subroot, root, H(proof + higher), digest, digest == root))
    return sorted(out, key=str)


def verified(spark, rows):
    extra = ("w", "x", "y", "z")
    docs = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)
    return sorted(map(tuple, merkle.verify(docs).collect()), key=str)


def row(i, lang, text=None):
    return (i, f"s{i % 3}", lang, i, f"Text {i}" if text is None else text)


@pytest.mark.parametrize("sizes", [[1], [8, 9], [65, 1, 513]])
def test_runs_and_languages(spark, sizes):
    rows = [row(i, f"l{k}") for k, n in enumerate(sizes) for i in range(1000 * k, 1000 * k + n)]
    assert verified(spark, rows) == expected(rows)


def test_many_languages(spark):
    rows = [row(i, f"lang {i % 70}") for i in range(200)]
    assert verified(spark, rows) == expected(rows)


def test_several_blocks(spark):
    rows = [row(i * 7, "en") for i in range(3 * 4096 + 5)] + [row(1, "de")]
    assert verified(spark, rows) == expected(rows)


def test_odd_rows(spark):
    odd = [(None, None, None, None, None), (5, "s", None, 3, None), (5, "s", None, 3, "ÄB" * 30_000), (9, "", "", 0, ""),
           (9, "", "", 0, ""), (None, "x", "fr", 1, "A"), (7, "x", "fr", 1, "already low"), (3, "a:b", "fr", 1, "1:a")]
    assert verified(spark, odd * 3) == expected(odd * 3)
    assert merkle.verify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_version_copies_its_ancestors_alone(spark):
    rows = [row(i, "en") for i in range(4096 + 9)]
    docs = spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA)
    tree = merkle.manifest(docs)
    made = merkle.versions(tree)
    changed = [r for r in rows if leaf((*r[:4], merkle_text(r))) != leaf(r)]
    inside = made.where("copies is not null").collect()
    assert len(inside) == len(changed)
    # a leaf and its four ancestors in a full block; the second block of nine leaves has its own four levels as well
    assert {len(r.copies) for r in inside} == {5}
    # one more level joins the two blocks, and nothing else is copied
    assert {len(r.copies) for r in merkle.continued(made, tree).collect()} == {6}
    # the stored tree is untouched: its root is that of the original rows
    assert {r.root.hex() for r in inside} == {expected(rows)[0][3]}


def merkle_text(r):
    return r[4].translate(UPPER) if zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]
