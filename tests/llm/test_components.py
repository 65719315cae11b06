import random

import pytest

from massloom.llm.components import connected_groups


def brute(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a in parent and b in parent and a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in nodes}


def run(spark, nodes, pairs):
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    p = spark.createDataFrame(pairs, "a string, b string")
    return {r.node: r.group_id for r in connected_groups(n, p, "node", "a", "b").collect()}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "cycle"])
def test_against_union_find(spark, shape):
    rng = random.Random(3)
    nodes = [f"n{i:04d}" for i in range(300)]
    mixed = nodes.copy()
    rng.shuffle(mixed)
    pairs = {
        "random": [(rng.choice(nodes), rng.choice(nodes)) for _ in range(200)],
        "chain": list(zip(mixed, mixed[1:], strict=False)),
        "star": [(mixed[0], x) if rng.random() < 0.5 else (x, mixed[0]) for x in mixed[1:250]],
        "cycle": [*zip(nodes, nodes[1:], strict=False), (nodes[-1], nodes[0])],
    }[shape]
    pairs += pairs[:20]
    assert run(spark, nodes, pairs) == brute(nodes, pairs)


def test_nulls_self_pairs_and_empty(spark):
    assert run(spark, ["a", "b", "b", None], [("a", "a"), (None, "b"), ("b", None)]) == {"a": "a", "b": "b"}
    assert run(spark, [], []) == {}
    assert run(spark, ["b", "\u00e9", "Z"], [("\u00e9", "b"), ("b", "Z")]) == {"b": "Z", "\u00e9": "Z", "Z": "Z"}
