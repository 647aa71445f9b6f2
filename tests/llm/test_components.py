"""Connected components against union-find."""

import random

import pytest

from sleuthframe.llm import components as components_module
from sleuthframe.llm.components import components


@pytest.mark.parametrize("small", [0, components_module.SMALL])
@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape, small, monkeypatch):
    monkeypatch.setattr(components_module, "SMALL", small)
    rng = random.Random(5)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 60)] + [(70, 71)], "random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)], "none": []}[shape]
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        lead[max(a, b)] = min(a, b)
    links = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary").repartition(7)
    got = {r["node"][0]: r["root"][0] for r in components(links).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}
