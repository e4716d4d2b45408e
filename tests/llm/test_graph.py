"""Connected components against a union-find on the same edges."""

import random

import pytest

from tessera.llm import graph


def truth(edges: list[tuple]) -> dict[int, int]:
    edges = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    of = {x: x for e in edges for x in e}
    while True:
        new = dict(of)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == of:
            return of
        of = new


def cases() -> dict[str, list[tuple]]:
    rng = random.Random(5)
    path = list(range(60))
    rng.shuffle(path)
    return {
        "empty": [],
        "nulls and loops": [(1, None), (None, 2), (3, 3), (None, None)],
        "path": list(zip(path, path[1:], strict=False)),
        "hub": [(7, i) for i in range(200)] + [(500, 501)],
        "random": [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(180)] * 2,
    }


@pytest.mark.parametrize("held", [4, graph.HELD_EDGES])
@pytest.mark.parametrize("name", list(cases()))
def test_components(spark, monkeypatch, name, held):
    monkeypatch.setattr(graph, "HELD_EDGES", held)
    edges = cases()[name]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    rows = [(r.id, r.component) for r in graph.connected_components(frame).collect()]
    assert len(rows) == len(set(rows))
    assert dict(rows) == truth(edges)
