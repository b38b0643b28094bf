import random

from ledgerwright.llm.components import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in list(parent)}


def run(spark, edges, kind="long"):
    df = spark.createDataFrame(edges, f"x {kind}, y {kind}")
    return {r["node"]: r["component"] for r in components(df, "x", "y").collect()}


def test_random_graphs(spark):
    rnd = random.Random(2)
    for n, m in ((30, 20), (60, 60)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(None, 1), (2, None)]
        assert run(spark, edges) == brute(edges)


def test_a_long_path_and_a_large_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(2000)]
    rnd = random.Random(3)
    edges = path + star
    rnd.shuffle(edges)
    assert run(spark, edges) == brute(edges)


def test_no_edges_and_texts(spark):
    assert run(spark, []) == {}
    assert run(spark, [("b", "a"), ("c", "c")], "string") == {"a": "a", "b": "a", "c": "c"}
