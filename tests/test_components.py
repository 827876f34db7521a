import random

from talewind.operators.components import components


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {(v, find(v)) for v in up if find(v) != v}


def run(spark, spool, edges, **kw):
    return {tuple(r) for r in components(spark.createDataFrame(edges, "x long, y long").repartition(4), spool, **kw).collect()}


def test_random_graphs_both_ways(spark, spool):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    assert run(spark, spool, edges) == roots([e for e in edges if e[0] != e[1]])
    assert run(spark, spool, edges, task_edges=0) == roots([e for e in edges if e[0] != e[1]])  # never in one task


def test_nulls_loops_repeats_and_nothing(spark, spool):
    assert run(spark, spool, [(3, 3), (None, 1), (2, None), (7, 9), (9, 7), (7, 9)]) == {(9, 7)}
    assert run(spark, spool, [(1, 1)]) == set()
