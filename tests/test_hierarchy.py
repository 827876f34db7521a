import random

import pytest

from talewind.operators.hierarchy import hierarchy


def brute(links):
    up = {k: p for k, p in links}
    out = {}
    for k in up:
        path, x, seen = [], k, set()
        while x is not None and x in up and x not in seen:
            seen.add(x)
            path.append(x)
            x = up[x]
        out[k] = "cycle" if x is not None and x in seen else "/".join(map(str, reversed(path)))
    return out


def sample(rng, n):
    links = [(i, None if rng.random() < 0.1 else rng.randrange(n)) for i in range(n)]  # many loops
    links += [(n + i, n + i - 1 if i else None) for i in range(150)]  # a deep chain
    links += [(10_000 + i, 10_000 if i else None) for i in range(120)]  # a broad parent
    links += [(20_000, 20_000), (20_001, 99_999), (20_002, -5)]  # its own parent, unknown parents
    return links


@pytest.mark.parametrize("task_rows", [1_000_000, 40])
def test_against_following_parents(spark, spool, task_rows):
    links = sample(random.Random(task_rows), 80)
    df = spark.createDataFrame([(k, p, "h", "extra") for k, p in links], "k long, p long, host string, path string").repartition(3)
    got = {r.k: r for r in hierarchy(df, spool, block_by="host", task_rows=task_rows).collect()}
    want = brute([(k, p) for k, p in links])
    assert {k: r.path for k, r in got.items()} == want
    below = {k: 0 for k in want}
    for k, path in want.items():
        if path != "cycle":
            for a in path.split("/")[:-1]:
                below[int(a)] += 1
    for k, r in got.items():
        if want[k] == "cycle":
            assert (r.depth, r.root, r.descendants, r.enter, r.leave) == (None,) * 5
        else:
            assert (r.depth, r.root, r.descendants) == (want[k].count("/"), int(want[k].split("/")[0]), below[k])
    for k, r in list(got.items())[::7]:  # descendants are the interval between enter and leave
        if r.root is not None:
            inside = {x for x, s in got.items() if s.root == r.root and r.enter < s.enter < r.leave}
            assert inside == {x for x, p in want.items() if x != k and p != "cycle" and str(k) in p.split("/")}


def test_empty_and_null_keys(spark, spool):
    assert hierarchy(spark.createDataFrame([], "k long, p long"), spool).count() == 0
    got = hierarchy(spark.createDataFrame([(None, 1), (0, None), (1, 0)], "k long, p long"), spool).collect()
    assert {(r.k, r.path) for r in got} == {(0, "0"), (1, "0/1")}


def test_groups_of_all_sizes_and_loops_between_them(spark, spool):
    """Small groups in one task each, large ones and rows without a group distributed, in one call."""
    rng = random.Random(4)
    rows = [(g * 1000 + i, None if rng.random() < 0.2 else g * 1000 + rng.randrange(n), f"g{g}") for g, n in enumerate([3, 200, 1, 90, 12]) for i in range(n)]
    rows += [(9_000 + i, 9_000 + i // 2 if i else None, None) for i in range(50)]
    got = hierarchy(spark.createDataFrame(rows, "k long, p long, host string"), spool, "host", task_rows=200).collect()
    assert {r.k: r.path for r in got} == brute([(k, p) for k, p, _ in rows])


def test_a_deep_chain_over_many_parts(spark, spool):
    rows = [(i, i - 1 if i else None) for i in range(900)]
    got = {r.k: r for r in hierarchy(spark.createDataFrame(rows, "k long, p long").repartition(4), spool, task_rows=100).collect()}
    assert all((r.depth, r.descendants, r.root) == (k, 899 - k, 0) and r.path.count("/") == k for k, r in got.items()) and len(got) == 900
