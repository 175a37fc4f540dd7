import random

from quietgrid.llm.common import Scratch, components, joined


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(5, 5), (7, None), (160, 100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).count() == 0


def test_further_edges(spark):
    """Edges between components, to new nodes, among new nodes, within a component, to itself and to null."""
    scratch = Scratch(spark, "cc")
    edges = [(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)]
    more = [(11, 3), (21, 40), (50, 51), (1, 3), (60, 60), (70, None), (5, 30)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    found = scratch.write(components(frame(edges), scratch))
    want = sorted(map(tuple, components(frame(edges + more), scratch).collect()))
    assert sorted(map(tuple, joined(found, frame(more), scratch).collect())) == want and (5, 5) in want
    assert sorted(map(tuple, joined(found, frame([]), scratch).collect())) == sorted(map(tuple, found.collect()))
    assert sorted(map(tuple, joined(scratch.write(components(frame([]), scratch)), frame(edges), scratch).collect())) == sorted(map(tuple, found.collect()))
