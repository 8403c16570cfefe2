import random

import pytest

from tidemill.llm import components
from tidemill.llm.components import connected_components


@pytest.mark.parametrize("written_from", [0, 10_000])
def test_components_equal_union_find(spark, monkeypatch, written_from):
    monkeypatch.setattr(components, "WRITTEN_FROM", written_from)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(500, i) for i in range(501, 560)] + [(7, 7), (99, 98), (98, 99)]
    edges += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(70)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        x, y = sorted((find(u), find(v)))
        root[y] = x
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    touched = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {(x, find(x)) for x in touched}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
