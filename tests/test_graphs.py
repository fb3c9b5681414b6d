"""Components, spanning forests and linking against sequential union-find, in one task and in rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelink.operators import linking
from kinelink.operators.graphs import connected_components, spanning_forest


def merged(nodes, edges):
    """Root of each node after each edge that joins two groups, and those edges."""
    root, taken = {n: n for n in nodes}, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        a, b = find(e[-2]), find(e[-1])
        if a != b:
            root[max(a, b)] = min(a, b)
            taken.append(e)
    return {n: find(n) for n in nodes}, taken


@pytest.mark.parametrize("at_once", [1 << 17, 0])
def test_components_and_forest(spark, at_once):
    rng = np.random.default_rng(2)
    edges = sorted({(float(rng.integers(0, 20)), int(a), int(b)) for a, b in rng.integers(0, 90, (110, 2))})
    df = spark.createDataFrame([*edges, edges[0], (1.0, None, 5), (0.0, 7, 7)], "w double, a long, b long")
    nodes = {x for e in edges for x in e[1:] if e[1] != e[2]}
    want, taken = merged(nodes, [e for e in edges if e[1] != e[2]])
    roots = {r.node: r.root for r in connected_components(df, at_once=at_once).collect()}
    assert roots.keys() == nodes and len({(want[n], roots[n]) for n in nodes}) == len(set(want.values())) == len(set(roots.values()))
    assert sorted((r.w, r.a, r.b) for r in spanning_forest(df, ["w"], at_once=at_once).collect()) == taken
    if not at_once:
        return
    assert connected_components(df.limit(0), at_once=at_once).collect() == [] and spanning_forest(df.limit(0), ["w"], at_once=at_once).collect() == []
    named = df.select("w", *(F.struct(F.lit("v").alias("video"), F.col(c).alias("id")).alias(c) for c in "ab")).filter("a.id is not null and b.id is not null")
    assert sorted((r.w, r.a.id, r.b.id) for r in spanning_forest(named, ["w"], at_once=at_once).collect()) == taken


@pytest.mark.parametrize("people", [1, 3, 8, 100])
def test_known_people_equal_taking_links_one_by_one(spark, people):
    rng = np.random.default_rng(people)
    tracks, links = [(v, t) for v in range(3) for t in range(25)], []
    for v in range(2):
        for a, b in rng.integers(0, 25, (40, 2)):
            if a != b:
                links.append((v, float(rng.integers(0, 9)) / 8, int(a), int(b)))
    want = {}
    for v in range(3):
        own = [t for w, t in tracks if w == v]
        joining = merged(own, sorted(x[1:] for x in links if x[0] == v))[1]
        roots = merged(own, joining[: max(len(own) - people, 1)])[0]
        order = sorted(set(roots.values()))
        want |= {(v, t): order.index(r) for t, r in roots.items()}
    stats = spark.createDataFrame(tracks, "video long, track_id long")
    out = linking.link_tracklets(stats, spark.createDataFrame(links, "video long, score double, src long, dst long"), ["video"], people)
    assert {(r.video, r.track_id): r.new_id for r in out.collect()} == want
