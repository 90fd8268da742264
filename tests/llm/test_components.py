"""Components of links against a union-find."""

import random

import pytest

from tablesieve.llm.components import components


def plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def ids(n):
    draw = random.Random(n)
    return [draw.getrandbits(63) - (1 << 62) for _ in range(n)]


GRAPHS = {
    "none": [],
    "itself": [(5, 5), (7, 9), (9, 9)],
    "rising path": [(k, k + 1) for k in range(200)],
    "shuffled path": list(zip(ids(150), ids(150)[1:])),
    "star of the largest": [(1000, k) for k in range(300)],
    "star of the smallest, repeated": [(k, 0) for k in range(1, 300)] * 2,
    "two stars and a bridge": [(1, k) for k in range(10, 60)] + [(2, k) for k in range(60, 99)] + [(59, 98)],
    "random": [tuple(random.Random(k).sample(range(400), 2)) for k in range(260)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    links = GRAPHS[name]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.root for r in rows} == plain(links)
