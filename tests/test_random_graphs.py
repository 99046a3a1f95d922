"""Floor joins, closures and ancestors on random inputs, against plain loops."""

import numpy as np

from tracewell.operators import edges, graph


def test_floor_join(spark):
    rng = np.random.default_rng(3)
    spans = [(i, f"f{rng.integers(0, 4)}", a := int(rng.integers(0, 60)), a + int(rng.integers(0, 12))) for i in range(120)]
    asked = [(f"f{rng.integers(0, 5)}", int(rng.integers(0, 80))) for _ in range(500)]
    places = spark.createDataFrame(asked, "file string, line int")
    got = edges.floor_join(places, spark.createDataFrame(spans, "id long, file string, a int, b int"), "file", "line", "a", "b", "id")
    for r in got.collect():
        before = [(a, b, i) for i, f, a, b in spans if f == r["file"] and a <= r["line"]]
        best = max(before, default=None)
        assert r["found"] == (best[2] if best and best[1] >= r["line"] else None)


def test_closure_and_ancestors(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 80, (110, 2))]
    entries = [3, 5]
    seen, front = set(entries), set(entries)
    while front:
        front = {b for a, b in links if a in front} - seen
        seen |= front
    got = graph.closure(spark.createDataFrame([(e,) for e in entries], "id long"), spark.createDataFrame(links, "source long, target long"))
    assert {r["id"] for r in got.collect()} == seen
    parent = {i: int(rng.integers(0, i)) for i in range(1, 60)}
    stops = {0, 7, 20}

    def climb(i):
        while i not in stops:
            i = parent[i]
        return i

    rows = spark.createDataFrame([(i, parent.get(i)) for i in range(60)], "node long, parent long")
    found = graph.nearest_ancestor(rows, spark.createDataFrame([(s,) for s in stops], "node long"))
    assert {r["node"]: r["ancestor"] for r in found.collect()} == {i: climb(i) for i in range(60)}
