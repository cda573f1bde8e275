import random

from tidemark.llm.components import components


def plain_components(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_random_graphs_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    links += [(1000 + i, 1001 + i) for i in range(60)]  # a long chain
    links += [(5000, 5001 + i) for i in range(300)] + [(-7, 5100)]  # a hub
    links += links[:20]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links + [(None, 3), (4, None), (9999, 9999)], "u long, v long")).collect()}
    assert found == plain_components([(u, v) for u, v in links if u != v])


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
