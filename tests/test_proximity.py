import math
import random

from terrane.operators import proximity


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def ok(lat, lon):
    return lat is not None and lon is not None and not math.isnan(lat) and not math.isnan(lon) and -90 <= lat <= 90 and -180 <= lon <= 180 and (lat, lon) != (0, 0)


def brute(rows, m):
    rows = [r for r in rows if ok(r[1], r[2])]
    return {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for b in rows[:i] if metres(a[1:3], b[1:3]) <= m}


def world():
    rng = random.Random(7)
    rows = []
    for lat, lon in [(48.1, 11.5), (0.0, 0.00001), (-59.5, 180.0), (89.99995, 20.0), (-90.0, 0.0), (12.0, -180.0), (51.0, 7.0)]:
        for _ in range(30):
            y = lat + rng.uniform(-2e-4, 2e-4)
            x = lon + rng.uniform(-2e-4, 2e-4) / max(0.02, math.cos(math.radians(lat)))
            rows.append((len(rows), max(-90.0, min(90.0, y)), (x + 180) % 360 - 180))
    n = len(rows)
    rows += [(n, 10.0, 180.0), (n + 1, 10.0, -180.0), (n + 2, 0.0, 0.0), (n + 3, None, 1.0), (n + 4, 1.0, None), (n + 5, float("nan"), 1.0), (n + 6, 91.0, 1.0), (n + 7, 48.1, 11.5), (n + 8, 48.1, 11.5), (n + 9, 0.0, -0.0), (n + 10, 90.0, 50.0), (n + 11, 90.0, -130.0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "id bigint, lat double, lon double, cell int, salt string")


def test_pairs_against_brute_force(spark):
    rows = world()
    for m in (10.0, 250.0):
        got = [tuple(r) for r in proximity.pairs_within(frame(spark, rows), m).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, m)


def test_hot_cells_are_salted(spark):
    rows = [(i, 48.1 + (i % 9) * 1e-6, 11.5) for i in range(300)]
    got = {tuple(r) for r in proximity.pairs_within(frame(spark, rows), 10.0, hot=20).collect()}
    assert got == brute(rows, 10.0) and len(got) == 300 * 299 // 2


def test_dense_cells_are_cut(spark):
    rows = world()
    rows += [(1000 + i, 48.1 + (i % 20) * 3e-5, 11.5 + (i // 20) * 5e-5) for i in range(200)]
    for dense, hot in ((3, 4096), (3, 4), (40, 10)):
        got = [tuple(r) for r in proximity.pairs_within(frame(spark, rows), 10.0, dense=dense, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 10.0)


def test_no_points(spark):
    assert proximity.pairs_within(frame(spark, []), 10.0).count() == 0


def inside(p, ring):
    out = False
    for (y0, x0), (y1, x1) in zip(ring, ring[1:] + ring[:1]):
        if (y0 > p[0]) != (y1 > p[0]) and p[1] < x0 + (x1 - x0) * (p[0] - y0) / (y1 - y0):
            out = not out
    return out


def test_regions(spark):
    rng = random.Random(2)
    rings = []
    for r in range(6):
        cy, cx = rng.uniform(-3, 3), rng.uniform(-3, 3)
        angles = sorted(rng.uniform(0, 6.28) for _ in range(9))
        rings.append((r, [(cy + rng.uniform(0.3, 2) * math.sin(a), cx + rng.uniform(0.3, 2) * math.cos(a)) for a in angles]))
    points = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(400)]
    t = spark.createDataFrame(rings, "region int, ring array<struct<lat:double,lon:double>>")
    got = {tuple(r) for r in proximity.containing_regions(frame(spark, points), t).collect()}
    assert got == {(p[0], r) for p in points for r, ring in rings if inside(p[1:], ring)} and got


def test_no_regions(spark):
    t = spark.createDataFrame([(1, [])], "region int, ring array<struct<lat:double,lon:double>>")
    assert proximity.containing_regions(frame(spark, [(1, 1.0, 1.0)]), t).count() == 0
    square = [(0.0, 1.0), (0.0, 3.0), (2.0, 3.0), (2.0, 1.0)]
    t = spark.createDataFrame([(1, square)], "region int, ring array<struct<lat:double,lon:double>>")
    assert proximity.containing_regions(frame(spark, []), t).count() == 0


def test_region_edges_holes_and_meridian(spark):
    square = [(0.0, 1.0), (0.0, 3.0), (2.0, 3.0), (2.0, 1.0), (0.0, 1.0)]
    hole = [(0.5, 1.5), (0.5, 2.5), (1.5, 2.5), (1.5, 1.5)]
    far = [(10.0, 179.0), (10.0, -179.0), (12.0, -179.0), (12.0, 179.0)]
    t = spark.createDataFrame([(1, square), (1, hole), (2, far), (3, []), (4, None), (5, [(5.0, 5.0)]), (None, square)], "region int, ring array<struct<lat:double,lon:double>>")
    points = [(1, 1.0, 1.2), (2, 1.0, 2.0), (3, 0.0, 2.0), (4, 2.0, 3.0), (5, 11.0, 179.5), (6, 11.0, -179.5), (7, 11.0, 178.9), (8, 1.0, 1.5), (9, 5.0, 5.0)]
    got = {tuple(r) for r in proximity.containing_regions(frame(spark, points), t).collect()}
    assert got == {(1, 1), (3, 1), (4, 1), (5, 2), (6, 2), (8, 1), (9, 5)}
    got = {tuple(r) for r in proximity.containing_regions(frame(spark, points), t, boundary=False).collect()}
    assert got == {(1, 1), (5, 2), (6, 2)}


def test_regions_on_the_grid_itself(spark):
    """Vertices, edges and points on lines and corners of the grid; cells so small that most hold no edge, and crowded ones."""
    rng = random.Random(4)
    grid = lambda n: rng.randrange(-n, n + 1) / 16
    rings = []
    for r in range(12):
        cy, cx = grid(16), grid(16)
        angles = sorted(rng.uniform(0, 6.28) for _ in range(7))
        rings.append((r, [v for v in [(cy + round(8 * math.sin(a) * rng.uniform(0.5, 1.5)) / 16, cx + round(8 * math.cos(a) * rng.uniform(0.5, 1.5)) / 16) for a in angles] if v != (0.0, 0.0)]))
    rings += [(20, [(0.0, 0.5), (0.5, 1.0), (1.0, 0.5), (0.5, 0.0)]), (21, [(-0.25, -0.25), (-0.25, 1.0), (1.0, 1.0), (1.0, -0.25)]), (21, [(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25)])]
    points = [(i, grid(32), grid(32)) for i in range(300)] + [(1000 + i, rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(200)]
    points = [p for p in points if p[1:] != (0.0, 0.0)]
    t = spark.createDataFrame(rings, "region int, ring array<struct<lat:double,lon:double>>")

    def at_edge(p, ring):
        return any(min(y0, y1) <= p[0] <= max(y0, y1) and min(x0, x1) <= p[1] <= max(x0, x1) and abs((p[1] - x0) * (y1 - y0) - (x1 - x0) * (p[0] - y0)) <= 1e-12 for (y0, x0), (y1, x1) in zip(ring, ring[1:] + ring[:1]))

    odd, rim = {}, set()
    for p in points:
        for r, ring in rings:
            odd[p[0], r] = odd.get((p[0], r), 0) ^ inside(p[1:], ring)
            if at_edge(p[1:], ring):
                rim.add((p[0], r))
    for cell, hot in ((1 / 16, 4096), (1 / 64, 4096), (0.03, 5), (1.0, 20)):
        got = [tuple(r) for r in proximity.containing_regions(frame(spark, points), t, cell, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == {x for x, n in odd.items() if n} | rim
        assert {tuple(r) for r in proximity.containing_regions(frame(spark, points), t, cell, False, hot).collect()} == {x for x, n in odd.items() if n} - rim


def test_a_region_of_many_edges_and_a_crowd_inside(spark):
    """Points inside meet few edges, however many the region has."""
    rng = random.Random(6)
    n = 10_000
    ring = [((2 + 0.1 * math.sin(40 * a)) * math.sin(a) + 10, (2 + 0.1 * math.sin(40 * a)) * math.cos(a) + 179) for a in (6.2831853 * i / n for i in range(n))]
    t = spark.createDataFrame([(1, [(y, (x + 180) % 360 - 180) for y, x in ring])], "region int, ring array<struct<lat:double,lon:double>>")
    points = [(i, 10 + rng.uniform(-2.5, 2.5), (179 + rng.uniform(-2.5, 2.5) + 180) % 360 - 180) for i in range(300)] + [(1000 + i, 10.0 + i * 1e-7, 179.0) for i in range(3000)]
    want = {(i, 1) for i, y, x in points if i >= 1000 or inside((y, x if x > 0 else x + 360), ring)}
    assert {tuple(r) for r in proximity.containing_regions(frame(spark, points), t, hot=500).collect()} == want
