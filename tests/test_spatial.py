import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import elements, spatial, tags
from terrane.operators.ranking import nth_value, ranked

OBJECT = "kind int, id bigint, mid_lat int, mid_lon int, weight bigint"


def objects(spark, rows):
    return spark.createDataFrame(rows, OBJECT)


def test_partition_is_whole_and_routed(spark):
    rng = random.Random(1)
    rows = [(0, i, rng.randrange(-(2**31) + 1, 2**31), rng.randrange(-(2**31) + 1, 2**31), rng.randint(1, 5)) for i in range(500)]
    o = objects(spark, rows)
    by_level, levels = spatial.kd_tree(o, 60, finish=0)
    mixed, both = spatial.kd_tree(o, 60, finish=130)
    assigned, tree = spatial.kd_tree(o, 60)
    assert sorted(by_level.collect()) == sorted(assigned.collect()) == sorted(mixed.collect()) and sorted(levels.collect()) == sorted(tree.collect()) == sorted(both.collect())
    got = {(r.kind, r.id): r.node_id for r in assigned.collect()}
    assert len(got) == 500
    splits = {r.node_id: r for r in tree.collect()}
    for kind, i, lat, lon, _ in rows:
        n = 1
        while n in splits:
            n = 2 * n + ((lat if splits[n].by_lat else lon) >= splits[n].split_value)
        assert got[kind, i] == n
    assert all(r.weight <= 60 for r in spatial.leaf_stats(assigned).collect())
    again = {(r.kind, r.id): r.node_id for r in spatial.assign(o, tree, 12).collect()}
    assert again == got


def test_ties_and_single_objects(spark):
    rows = [(0, i, 5, 7, 1) for i in range(20)] + [(1, 1, 5, 8, 1), (1, 2, 9, 9, 1000)]
    assigned, _ = spatial.kd_tree(objects(spark, rows), 4)
    s = {(r.items, r.weight) for r in spatial.leaf_stats(assigned).collect()}
    assert s == {(20, 20), (1, 1), (1, 1000)}
    assert sorted(assigned.collect()) == sorted(spatial.kd_tree(objects(spark, rows), 4, finish=2)[0].collect())


def test_no_objects(spark):
    assigned, tree = spatial.kd_tree(objects(spark, []), 4)
    assert assigned.count() == 0 and tree.count() == 0


@pytest.mark.parametrize("values", [[random.Random(125).randrange(-(2**31), 2**31) for _ in range(1000)], [i % 300 for i in range(1000)]])
def test_nth_value(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "g int, v int")
    for k in (0, 500, 999):
        assert nth_value(df, "g", "v", spark.createDataFrame([(1, k)], "g int, k bigint")).first().value == sorted(values)[k]


def test_ranked(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {(r.g, r.v, r.i): r["rank"] for r in ranked(df, F.shiftright("v", 3), ["v", "i"], ["g"]).collect()}
    for g in "ab":
        assert [got[x] for x in sorted(x for x in rows if x[0] == g)] == list(range(sum(x[0] == g for x in rows)))


def test_way_edges(spark):
    meta = ", version int, visible boolean, extra int"
    n = spark.createDataFrame([(1, 1.0, 1.0, 1, True, 0), (2, 2.0, 4.0, 1, None, 0), (3, None, 1.0, 1, True, 0), (4, 1.0, 1.0, 1, False, 0)], "id bigint, lat double, lon double" + meta)
    w = spark.createDataFrame([(1, [1, 2, 1, None], 1, True, 0), (2, [], 1, True, 0), (3, None, 1, True, 0), (4, [3, 4, 5], 1, True, 0), (5, [1], 2, False, 0), (5, [1], 1, True, 0)], "id bigint, refs array<bigint>" + meta)
    assert [(r.way_id, r.pos, r.node_id) for r in elements.way_geometry(w, n).orderBy("way_id", "pos").collect()] == [(1, 0, 1), (1, 1, 2), (1, 2, 1)]
    assert {(r.way_id, r.n_nodes, r.mid_lat is None) for r in elements.way_info(w, n).collect()} == {(1, 3, False), (2, 0, True), (3, 0, True), (4, 0, True)}
    assert elements.way_geometry(w, n, "null").filter("lat IS NULL").count() == 3
    with pytest.raises(Exception, match="without position"):
        elements.way_geometry(w, n, "error").collect()


def test_way_classes(spark):
    t = spark.createDataFrame([(1, 1, "Highway", "PRIMARY_LINK"), (1, 2, "building", "yes"), (1, 2, "highway", "odd"), (1, 3, "BUILDING", None), (0, 4, "highway", "steps"), (1, 5, "highway", None)], "kind tinyint, id bigint, k string, v string")
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "id bigint")
    assert {tuple(r) for r in tags.way_class(ids, t).collect()} == {(1, 5), (2, 2), (3, 100), (4, 1), (5, 2)}


def test_codes(spark, tmp_path):
    p = tmp_path / "codes.json"
    p.write_text('{"KeyCodes": {"a": 7}, "NodeTagCodes": [{"Key": "a", "Value": "b", "TagId": 1}], "WayTagCodes": [], "TagCodes": [{"Key": "a", "Value": "c", "TagId": 2}], "KeyStopList": ["s"]}')
    c = tags.Codes.read(str(p))
    t = spark.createDataFrame([(0, 1, "a", "b"), (0, 2, "a", "c"), (0, 3, "a", None), (0, 4, "s", "b"), (0, 5, None, "b"), (0, 6, "z", "b")], "kind tinyint, id bigint, k string, v string")
    assert {tuple(r) for r in tags.checked(tags.encode(t, c, "node")).collect()} == {(0, 1, 1, None, None), (0, 2, 2, None, None), (0, 3, None, 7, None)}
    assert tags.encode(t, tags.Codes()).count() == 0
