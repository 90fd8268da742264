"""Chat trees: what is read back, what is shared, where tokens stand and what they attend to."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, strategies as st

from tablesieve.llm import chat
from tablesieve.llm.encoding import library_tokenizer
from tablesieve.llm.queries import BYTE_BPE, PLANTED_TURNS
from tablesieve.runtime import scratch_path

SCHEMA = "conv_id long, turn long, role string, text string, chain string, place string, owner string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def formatted(spark, rows):
    uri = scratch_path(spark, "chat-test")
    chat.format_tree(frame(spark, rows), BYTE_BPE, uri)
    return uri


def conversations(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = []
    for conv, turns in conversations(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len("".join(chat.segments(r, t))) for r, t in turns)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars))
    return sorted(out, key=str)


def check(spark, rows):
    uri = formatted(spark, rows)
    assert sorted(map(tuple, chat.summary(spark, BYTE_BPE, uri).collect()), key=str) == expected(rows)
    return uri


def tree_rows(rows):
    """Conversations that part at many places, and repeat each other."""
    made = list(PLANTED_TURNS)
    for c in range(40):
        for turn in range(1 + c % 7):
            shared = turn < c % 4
            made.append((c, turn, ("user", "assistant")[turn % 2], f"turn {turn}" if shared else f"turn {turn} of {c // 2}"))
    return made + rows


ODD = [
    (100, None, None, None), (100, 3, "assistant", None), (100, 3, "assistant", "b"), (100, 3, "assistant", "b"),
    (None, 0, "user", "no conversation"), (None, 0, "assistant", "<|endoftext|> \\<turn:user>\n</turn>\n"),
    (101, 0, "us>er\\", "\\"), (101, 1, "assistant", "long ü " * 30_000), (102, 0, "", ""), (103, 5, "system", "\n"),
]


def test_read_back(spark):
    check(spark, tree_rows(ODD))


def test_empty(spark):
    assert check(spark, []) and True


def test_shared_turns_are_written_once_and_seen_by_all(spark):
    rows = tree_rows([])
    uri = formatted(spark, rows)
    nodes = [r.asDict(recursive=True) for r in spark.read.parquet(f"{uri}/nodes").collect()]
    told = conversations(rows)
    prefixes = {tuple(turns[: k + 1]) for turns in told.values() for k in range(len(turns))}
    assert len(nodes) == len(prefixes)
    by_tree = {}
    for n in nodes:
        by_tree.setdefault(n["tree"], []).append(n)
    assert len(by_tree) == len({turns[0] for turns in told.values()})
    where = {}
    for tree, members in by_tree.items():
        members.sort(key=lambda n: n["start"])
        at = 0
        for n in members:
            assert n["start"] == at, "tokens of a tree have no gaps"
            at += len(n["ids"]) // 4
            where[n["chain"], n["place"]] = n
    tokenizer = library_tokenizer(BYTE_BPE)
    spans = {r.conv_id: r.spans for r in spark.read.parquet(f"{uri}/convs").collect()}
    for conv, turns in told.items():
        path = [where[s.chain, p] for s in spans[conv] for p in range(s.first, s.last + 1)]
        ids = [tokenizer.encode(part, add_special_tokens=False).ids for t in turns for part in chat.segments(*t)]
        assert np.concatenate([np.frombuffer(n["ids"], "<u4") for n in path]).tolist() == sum(ids, [])
        position, before = 0, []
        for n in path:
            assert n["position"] == position
            seen = [t for i in n["attends"] for t in range(i["from"], i["to"])]
            assert seen == before, "a node attends to its ancestors' tokens, no more and no less"
            before = before + list(range(n["start"], n["start"] + len(n["ids"]) // 4))
            position += len(n["ids"]) // 4


def test_depth_first(spark):
    """Whatever lies between a node and the end of its subtree is below it."""
    uri = formatted(spark, tree_rows([]))
    told = conversations(tree_rows([]))
    where = {(r.chain, r.place): r for r in spark.read.parquet(f"{uri}/nodes").collect()}
    below = {}
    for r in spark.read.parquet(f"{uri}/convs").collect():
        path = [(s.chain, p) for s in r.spans for p in range(s.first, s.last + 1)]
        for i, node in enumerate(path):
            below.setdefault(node, set()).update(path[i:])
    assert len(told) == 41
    for node, members in below.items():
        starts = sorted((where[m].start, where[m].start + len(where[m].ids) // 4) for m in members)
        assert starts[0][0] == where[node].start
        assert all(a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False)), "a subtree is one stretch"


@pytest.mark.parametrize("parts", [300])
def test_long_and_hot(spark, parts):
    """One conversation and one first turn with most of the rows; many chains that part from each other in turn."""
    rows = [(1, t, "user", f"t{t}") for t in range(parts)]
    rows += [(c, t, "user", f"t{t}" if t < c - 1 else f"own {c}") for c in range(2, 40) for t in range(c)]
    rows += [(1000 + c, 0, "user", "t0") for c in range(200)]
    check(spark, rows)


@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="\\<>/turn: é\n#", max_size=30)), max_size=6))
def test_template_is_reversible(turns):
    assert chat.taken_apart("".join("".join(chat.segments(*t)) for t in turns)) == turns
