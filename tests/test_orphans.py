import random
from datetime import datetime, timedelta

from terrane.operators import orphans
from terrane.streaming.orphans import OrphanStream, arrivals

T = datetime(2020, 1, 1)
META = "version int, ts timestamp, changeset bigint, visible boolean, loaded_at timestamp"


def at(n):
    return T + timedelta(hours=n)


def frames(spark, nodes, ways, relations):
    return {
        0: spark.createDataFrame(nodes, f"id bigint, lat double, lon double, {META}, kind string"),
        1: spark.createDataFrame(ways, f"id bigint, refs array<bigint>, {META}"),
        2: spark.createDataFrame(relations, f"id bigint, members array<struct<type:tinyint,ref:bigint,role:string>>, {META}"),
    }


def brute(nodes, ways, relations):
    rows = {}
    for kind, table in enumerate((nodes, ways, relations)):
        for r in table:
            r = r[:-1] if kind == 0 else r
            i, payload = r[0], r[1]
            version, visible, loaded = r[-5] if r[-5] is not None else -(2**31), r[-2], r[-1]
            if i is not None:
                rows.setdefault((kind, i), []).append((version, True if visible is None else visible, loaded, payload))
    out = set()
    for (kind, i), own in rows.items():
        if kind == 0:
            continue
        top = max(r[0] for r in own)
        best = [r for r in own if r[0] == top]
        if not best[0][1]:
            continue
        since = min(r[2] for r in best)
        for pos, x in enumerate(best[0][3] or []):
            t, ref = (0, x) if kind == 1 else (x[0], x[1])
            if t is None or ref is None:
                continue
            target = rows.get((t, ref))
            if target is None:
                out.add((kind, i, pos, ref))
                continue
            v = max(r[0] for r in target)
            if not [r for r in target if r[0] == v][0][1] or min(r[2] for r in target) > since:
                out.add((kind, i, pos, ref))
    return out


def world(seed):
    rng = random.Random(seed)
    nodes, ways, relations = [], [], []
    visible = lambda: rng.choice([True, True, True, None, False])
    for table in (nodes, ways, relations):
        for i in range(25):
            for v in range(1, rng.randint(1, 3) + 1):
                vis, loaded = visible(), at(rng.randint(0, 60))
                if table is nodes:
                    row = (i, 0.0, 0.0, v, None, None, vis, loaded, "x")
                elif table is ways:
                    row = (i, rng.choice([None, [], [rng.choice([None, rng.randint(0, 30)]) for _ in range(4)]]), v, None, None, vis, loaded)
                else:
                    row = (i, rng.choice([None, [], [(rng.choice([None, 0, 1, 2]), rng.choice([None, rng.randint(0, 30)]), "r") for _ in range(4)]]), v, None, None, vis, loaded)
                table.append(row)
                if rng.random() < 0.3:
                    again = list(row)
                    again[-2 if table is nodes else -1] = loaded + timedelta(hours=rng.choice([0, 5]))
                    table.append(tuple(again))
    nodes.append((None, 0.0, 0.0, 1, None, None, True, at(1), "x"))
    ways.append((None, [1], 1, None, None, True, at(1)))
    nodes.append((99, 0.0, 0.0, None, None, None, True, at(1), "x"))
    for t in (nodes, ways, relations):
        rng.shuffle(t)
    return nodes, ways, relations


def found(state):
    return {(r.kind, r.id, r.pos, r.ref) for r in orphans.orphans(state).collect()}


def test_any_number_of_batches_gives_the_same(spark):
    for seed in (1, 2):
        w = world(seed)
        want = brute(*w)
        assert want
        for n in (1, 3):
            assert found(orphans.replay(frames(spark, *w), n)) == want


def test_batches_in_any_order(spark):
    """Arrival times decide, not the order in which batches come."""
    w = world(3)
    state = orphans.OrphanState()
    for b in reversed(orphans.batches(frames(spark, *w), 3)):
        state = orphans.advance(state, b)
    assert found(state) == brute(*w)


def test_resolve_and_reopen(spark):
    way = (1, [7], 1, at(0), 5, True, at(0))
    state = orphans.advance(orphans.OrphanState(), frames(spark, [], [way], []))
    assert [(r.ref, r.reason, r.month) for r in orphans.orphans(state).collect()] == [(7, "missing", "2020-01")]
    state = orphans.advance(state, frames(spark, [(7, 0.0, 0.0, 1, None, None, True, at(0), "x")], [], []))
    assert found(state) == set()
    state = orphans.advance(state, frames(spark, [(7, 0.0, 0.0, 2, None, None, False, at(2), "x")], [], []))
    assert [r.reason for r in orphans.orphans(state).collect()] == ["deleted"]
    state = orphans.advance(state, frames(spark, [(7, 0.0, 0.0, 3, None, None, None, at(3), "x")], [], []))
    assert found(state) == set()
    state = orphans.advance(state, frames(spark, [], [(1, [8, None, 8], 2, None, 5, True, at(4))], []))
    assert found(state) == {(1, 1, 0, 8), (1, 1, 2, 8)}
    assert [(r.kind, r.type, r.month, r.n_refs) for r in orphans.report(state).collect()] == [(1, 0, None, 2)]


def test_empty(spark):
    assert found(orphans.replay(frames(spark, [], [], []), 2)) == set()


def test_stream(spark, tmp_path):
    w = world(4)
    t = frames(spark, *w)
    source = tmp_path / "in"
    arrivals(t[0], t[1], t[2]).repartition(3).write.parquet(str(source))
    stream = OrphanStream(spark, str(tmp_path / "state"))
    feed = spark.readStream.schema(spark.read.parquet(str(source)).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = stream.start(feed, str(tmp_path / "checkpoint"))
    q.awaitTermination()
    assert {(r.kind, r.id, r.pos, r.ref) for r in orphans.orphans(stream.state()).collect()} == brute(*w)
    assert stream.report().count() > 0
