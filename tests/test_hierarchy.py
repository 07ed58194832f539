import random

import pytest

from terrane.operators import hierarchy
from terrane.plans import registry
from tests.oracle import connect, same


def brute(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for v in {x for cp in parent.items() for x in cp}:
        seen, path = {}, [v]
        while path[-1] in parent and path[-1] not in seen:
            seen[path[-1]] = len(path) - 1
            path.append(parent[path[-1]])
        if path[-1] not in parent:
            out[v] = (path[-1], len(path) - 1, "/".join(map(str, reversed(path))))
        else:
            ring = path[seen[path[-1]] : -1]
            out[v] = (min(ring), -1 if v in ring else -2, "")
    return out


def check(spark, links):
    df = spark.createDataFrame([(*x, "e") for x in links], "child bigint, parent bigint, id string")
    rows = hierarchy.hierarchies(df).collect()
    got = {r.id: (r.root_id, r.depth, r.path) for r in rows}
    assert len(rows) == len(got)
    assert got == brute(links)


@pytest.mark.parametrize("seed", range(3))
def test_forests_with_circles(spark, seed):
    rng = random.Random(seed)
    links = [(i, rng.randrange(max(0, i - 6), i)) for i in range(1, 60) if rng.random() < 0.9]
    links += [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200 + i, 199 + i) for i in range(5)] + [(200, 103)]
    links += [(300, 300), (301, 300), (302, 301), (400, 401), (401, 400)]
    rng.shuffle(links)
    check(spark, links + links[:5])


def test_long_chain_and_star(spark):
    check(spark, [(i, i - 1) for i in range(1, 80)] + [(1000 + i, 79) for i in range(50)])


def test_edges(spark):
    check(spark, [])
    check(spark, [(None, 1), (2, None), (3, 4), (3, 2)])


def test_large_ids(spark):
    n = 2**60
    links = [(n + 1, n), (n + 2, n + 1), (n + 5, n + 5), (n + 6, n + 5), (n + 7, n + 6), (n + 9, n + 8), (n + 8, n + 9)]
    check(spark, links)


def test_rounds_grow_slowly(spark, monkeypatch):
    n = []
    real = hierarchy._round
    monkeypatch.setattr(hierarchy, "_round", lambda links, i: (n.append(i), real(links, i))[1])
    check(spark, [(i, i - 1) for i in range(1, 65)])
    assert len(n) <= 30


def test_descendants(spark):
    t = hierarchy.hierarchies(spark.createDataFrame([(2, 1), (3, 2), (4, 2), (9, 9)], "child bigint, parent bigint"))
    assert {tuple(r) for r in hierarchy.descendants(t).collect()} == {(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1)}


def test_links_of_relations(spark):
    schema = "id bigint, members array<struct<type:tinyint,ref:bigint,role:string>>, version int, visible boolean, child string"
    rows = [(1, [(2, 2, "a"), (2, 2, "b"), (2, None, "c"), (None, 3, "d"), (1, 3, "e"), (2, 9, "f"), (2, 4, "g")], 2, None, "x"), (1, [(2, 3, "")], 1, True, "x"), (2, [], 1, True, "x"), (3, None, 1, True, "x"), (4, [], 1, False, "x"), (None, [(2, 3, "")], 1, True, "x")]
    assert {tuple(r) for r in hierarchy.relation_links(spark.createDataFrame(rows, schema)).collect()} == {(2, 1)}


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_query_contracts(spark, monkeypatch, size):
    """The registered queries against SQL, by rounds alone."""
    rounds = []
    real = hierarchy._round
    monkeypatch.setattr(hierarchy, "_round", lambda links, i: (rounds.append(i), real(links, i))[1])
    d = f"/root/testdata/{size}"
    same(registry.QUERIES["p2_found"](spark, d), connect(d), registry.SQL["p2_found"])
    assert len(rounds) > 2
    if size == "sf0.01":
        same(registry.QUERIES["p2_descendants"](spark, d), connect(d), registry.SQL["p2_descendants"])
