"""Components of few edges are found in one task, those of many by rounds of joins: the same ones."""

import random

import pytest

from wayfold.llm import components


@pytest.mark.parametrize("in_one_task", [0, 1_000_000])
def test_components_of_few_and_many_edges(spark, monkeypatch, in_one_task):
    rng = random.Random(9)
    edges = [(rng.randrange(90) * 7, rng.randrange(90) * 7) for _ in range(60)] + [(5, 5), (2_000, 1_999), (1_999, 2_000)]
    least = {i: i for e in edges for i in e}
    for _ in edges:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    monkeypatch.setattr(components, "IN_ONE_TASK", in_one_task)
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == sorted((i, c) for i, c in least.items() if i != c)
    assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()
