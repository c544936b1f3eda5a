import random

import pytest

from docweave.operators.hierarchy import closure, cycle_members, descendant_counts, hierarchy


def brute(parent):
    """(cycle of each node or None, path of each node or None) by walking up."""
    cycles, paths = {}, {}
    for start in parent:
        seen, at = [], start
        while at is not None and at not in seen:
            seen.append(at)
            at = parent.get(at) if parent.get(at) in parent else None
        if at is None:
            paths[start] = seen[::-1]
        else:
            ring = seen[seen.index(at) :]
            paths[start] = None
            if start in ring:
                cycles[start] = min(ring)
    return cycles, paths


def _case(seed):
    rnd = random.Random(seed)
    n = rnd.choice([1, 5, 40])
    ids = [f"n{i:03d}" for i in range(n)]
    parent = {x: rnd.choice([None, "gone", rnd.choice(ids), ids[max(0, i - 1)]]) for i, x in enumerate(ids)}
    if n > 20:  # a long chain and a long circle
        for i in range(1, 15):
            parent[ids[i]] = ids[i - 1]
        for i in range(16, 23):
            parent[ids[i]] = ids[i + 1] if i < 22 else ids[16]
    return parent


@pytest.mark.parametrize("seed", [1, 2, 4])
def test_against_walking_up(spark, seed):
    parent = _case(seed)
    cycles, paths = brute(parent)
    df = spark.createDataFrame(list(parent.items()), "id string, parent string").selectExpr("*", "'x' AS hops", "1 AS step", "2 AS root")
    found = {r["id"]: r["cycle_id"] for r in cycle_members(df, "id", "parent").collect()}
    assert found == cycles
    tree = hierarchy(df, "id", "parent")
    got = {r["id"]: r for r in tree.collect()}
    assert set(got) == set(parent)
    for x, path in paths.items():
        assert got[x]["path"] == path
        assert got[x]["depth"] == (len(path) - 1 if path else None) and got[x]["root"] == (path[0] if path else None)
    below = {x: sum(1 for p in paths.values() if p and x in p[:-1]) for x, p in paths.items() if p}
    assert {r["id"]: r["descendants"] for r in descendant_counts(tree).collect()} == below
    assert closure(tree).count() == sum(below.values())


def test_empty_null_and_repeated(spark):
    shape = "id string, parent string"
    assert cycle_members(spark.createDataFrame([], shape), "id", "parent").count() == 0
    assert hierarchy(spark.createDataFrame([], shape), "id", "parent").count() == 0
    df = spark.createDataFrame([("a", "a"), (None, "a"), ("b", "a"), ("b", "a"), ("c", None), ("c", None)], shape)
    assert [tuple(r) for r in cycle_members(df, "id", "parent").collect()] == [("a", "a")]
    assert {r["id"]: r["path"] for r in hierarchy(df, "id", "parent").collect()} == {"a": None, "b": None, "c": ["c"]}
