"""Components by rounds and by one task against brute force."""

from __future__ import annotations

import random

import pytest

from lektura.llm.components import components


def graph(seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 600 + i) for i in range(60)]  # a chain and a hub
    edges += [(rng.randrange(-2000, -1000), rng.randrange(-2000, -1000)) for _ in range(400)]
    return edges + [(7, 7), (-(2**63), 2**63 - 1)] + edges[:20]


def parts(edges):
    root = {}
    for a, b in edges:
        if a != b:
            one, other = root.get(a, {a}), root.get(b, {b})
            both = one | other
            root.update(dict.fromkeys(both, both))
    return {frozenset(x) for x in root.values()}


@pytest.mark.parametrize("few", [0, 100, None])
def test_components_of_either_form(spark, few):
    edges = graph(few or 0)
    rows = components(spark.createDataFrame(random.Random(1).sample(edges, len(edges)), "src long, dst long"), few).collect()
    held = {}
    for r in rows:
        held.setdefault(r["root"], set()).add(r["node"])
    assert len(rows) == len({r["node"] for r in rows})
    assert all(root in nodes for root, nodes in held.items()) and {frozenset(x) for x in held.values()} == parts(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "src long, dst long")).collect() == []


def test_small_graphs_take_few_jobs(spark):
    edges = spark.createDataFrame(graph(2), "src long, dst long")
    spark.sparkContext.setJobGroup("components", "")
    components(edges).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 10
