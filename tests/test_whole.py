"""Cases in which a query or operator once did less than its whole job."""

import collections

import pytest

from quarry import catalog
from quarry.operators import graph as G
from quarry.operators import search as S
from quarry.plans.relations import Relations


def test_pagerank_runs_all_rounds(spark, sf):
    r = Relations(spark, sf)
    seeds = [x.id for x in r.nodes().filter("kind = 'interface'").collect()]
    near = collections.defaultdict(list)
    for x in G.walkable(r.edges()).collect():
        near[x.source].append(x.target)
        near[x.target].append(x.source)
    mass = dict.fromkeys(seeds, 1 / len(seeds))
    for _ in range(25):
        step, lost = collections.defaultdict(float), 0.0
        for x, m in mass.items():
            for y in near[x]:
                step[y] += 0.75 * m / len(near[x])
            lost += 0.75 * m if not near[x] else 0.0
        for x in seeds:
            step[x] += (0.25 + lost) / len(seeds)
        mass = step
    got = {x.id: x.rank for x in catalog.QUERIES["graph_pagerank"](spark, sf).collect()}
    top = max(mass.values())
    assert got == pytest.approx({x: m / top for x, m in mass.items()}, abs=2e-6)


def test_reciprocal_fuses_every_hit(spark):
    rows = [(k, "big", 1000.0 - k // 3) for k in range(700)] + [(k, "small", 900.0 - k) for k in range(0, 700, 5)] + [(k, "weak", 1.0) for k in range(9)] + [(999, "big", 0.0)]
    want, first = collections.defaultdict(float), {}
    for scope in ("big", "small"):
        own = sorted((-score, k) for k, at, score in rows if at == scope and score > 0)
        for pos, (_, k) in enumerate(own, 1):
            want[k] += 1 / (60 + pos)
            first[k] = min(pos, first.get(k, pos))
    got = {r.id: (r.pos, r.fused) for r in S.reciprocal(spark.createDataFrame(rows, "id long, scope string, score double").repartition(7)).collect()}
    assert {k: pos for k, (pos, _) in got.items()} == first
    assert {k: fused for k, (_, fused) in got.items()} == pytest.approx({k: v / max(want.values()) for k, v in want.items()})


def test_components_by_either_way(spark, sf):
    edges = Relations(spark, sf).follows()
    rows = lambda n: sorted(map(tuple, G.components_of(edges, in_one_task=n).collect()))
    assert rows(G.IN_ONE_TASK) == rows(10) != []
    assert G.strong_components([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "a")]) == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}
