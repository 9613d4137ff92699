"""Classes of linked rows."""

import random

from tokenloom.operators import graph


def brute(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(top)}


def result(spark, edges):
    return {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_random_graph(spark):
    rnd = random.Random(5)
    edges = [(a, b) for a, b in ((rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)) if a != b]
    assert result(spark, edges) == brute(edges)


def test_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    assert result(spark, path + star) == brute(path + star)


def test_empty_and_loops(spark):
    assert result(spark, []) == {} and result(spark, [(3, 3)]) == {}


def test_stars(spark):
    rows = spark.createDataFrame([(i, "hot" if i < 200 else f"k{i % 5}") for i in range(300)] + [(300, None), (301, None)], "row_id long, k string")
    edges, heads = graph.stars(rows, ["k"])
    roots = brute([(r.a, r.b) for r in edges.collect()])
    assert roots[199] == 0 and roots[299] == 204 and roots[301] == 300
    assert sorted(r.row_id for r in heads.collect()) == [0, 200, 201, 202, 203, 204, 300]


def test_path_with_shuffled_numbers(spark):
    names = list(range(200))
    random.Random(9).shuffle(names)
    path = list(zip(names, names[1:]))
    assert result(spark, path) == brute(path)
