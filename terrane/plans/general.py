"""Queries of the general data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import hierarchy, multivalue, orphans, proximity, versions
from terrane.session import load, materialize

ORPHAN_BATCHES, SNAPSHOTS = 2, 4


def _elements(spark, d):
    return {kind: load(spark, d, t) for kind, t in enumerate(("nodes", "ways", "relations"))}


def p1_found(spark, d):
    return orphans.orphans(orphans.replay(_elements(spark, d), ORPHAN_BATCHES)).select("kind", "id", "pos", "ref")


def p1_report(spark, d):
    return orphans.report(orphans.replay(_elements(spark, d), ORPHAN_BATCHES))


def p1_snapshots(spark, d):
    """The report after each batch: how many references were orphans by then."""
    taken = []
    orphans.replay(_elements(spark, d), SNAPSHOTS, lambda i, state: taken.append(materialize(orphans.report(state).select(F.lit(i).alias("snapshot"), "*"))))
    out = taken[0]
    for x in taken[1:]:
        out = out.unionAll(x)
    return out


def p2_found(spark, d):
    return hierarchy.hierarchies(hierarchy.relation_links(load(spark, d, "relations")))


def p2_descendants(spark, d):
    return hierarchy.descendants(p2_found(spark, d))


def p4_found(spark, d):
    return multivalue.split_tags(load(spark, d, "tags"), load(spark, d, "list_keys"))


def p5_found(spark, d):
    return proximity.pairs_within(versions.current(load(spark, d, "nodes"), ["lat", "lon"]), 10.0)


def p5_regions(spark, d):
    """The closed ways that hold each node, those on their edges included."""
    nodes, ways = versions.current(load(spark, d, "nodes"), ["lat", "lon"]), versions.current(load(spark, d, "ways"), ["refs"])
    return proximity.containing_regions(nodes, proximity.way_rings(ways, nodes)).select("id", F.col("region").alias("way_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_snapshots, p2_found, p2_descendants, p4_found, p5_found, p5_regions)}

_CURRENT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST) AS rn FROM {t}) WHERE rn = 1 AND coalesce(visible, true)"""

_P1 = f"""WITH c AS (SELECT 1 AS kind, w.id, w.ts, 0 AS type, unnest(refs) AS ref, generate_subscripts(refs, 1) - 1 AS pos FROM ({_CURRENT.format(t="ways")}) w
  UNION ALL SELECT 2, id, ts, m.type, m.ref, pos FROM (SELECT id, ts, unnest(members) AS m, generate_subscripts(members, 1) - 1 AS pos FROM ({_CURRENT.format(t="relations")}))),
e AS (SELECT 0 AS kind, id, version, visible, loaded_at FROM nodes UNION ALL SELECT 1, id, version, visible, loaded_at FROM ways UNION ALL SELECT 2, id, version, visible, loaded_at FROM relations),
t AS (SELECT kind, id, min(loaded_at) AS first_at, arg_max(coalesce(visible, true), version) AS live, max(version) AS version FROM e GROUP BY kind, id),
s AS (SELECT e.kind, e.id, min(loaded_at) AS since FROM e JOIN t ON e.kind = t.kind AND e.id = t.id AND e.version = t.version GROUP BY e.kind, e.id),
o AS (SELECT c.* FROM c JOIN s USING (kind, id) LEFT JOIN t ON t.kind = c.type AND t.id = c.ref
  WHERE c.type IS NOT NULL AND c.ref IS NOT NULL AND (t.id IS NULL OR NOT t.live OR t.first_at > s.since)) """

_P2 = f"""WITH RECURSIVE now AS MATERIALIZED ({_CURRENT.format(t="relations")}),
l AS MATERIALIZED (SELECT child, min(parent) AS parent FROM (SELECT parent, m.type AS type, m.ref AS child FROM (SELECT id AS parent, unnest(members) AS m FROM now)) WHERE type = 2 AND child IN (SELECT id FROM now) GROUP BY child),
n AS (SELECT child AS id FROM l UNION SELECT parent FROM l),
up AS (SELECT id, id AS root_id, 0 AS depth, id::VARCHAR AS path FROM n WHERE id NOT IN (SELECT child FROM l)
  UNION ALL SELECT l.child, up.root_id, up.depth + 1, up.path || '/' || l.child FROM up JOIN l ON l.parent = up.id),
rest AS MATERIALIZED (SELECT l.* FROM l ANTI JOIN up ON l.child = up.id),
walk AS (SELECT child AS v, parent AS w FROM rest UNION SELECT walk.v, rest.parent FROM walk JOIN rest ON rest.child = walk.w),
ring AS MATERIALIZED (SELECT DISTINCT v AS id FROM walk WHERE v = w),
reach AS (SELECT v AS id, min(w) AS least FROM walk WHERE w IN (SELECT id FROM ring) GROUP BY v) """

_P5R = f"""WITH n AS MATERIALIZED (SELECT id, lat, lon FROM ({_CURRENT.format(t="nodes")}) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0)),
w AS MATERIALIZED (SELECT id, refs FROM ({_CURRENT.format(t="ways")}) WHERE len(refs) >= 4 AND refs[1] = refs[len(refs)]),
v AS (SELECT w.id AS way, pos, lat AS y, lon AS x, count(*) OVER (PARTITION BY w.id) AS m, size FROM (SELECT id, len(refs) AS size, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM w) w JOIN n ON n.id = w.ref),
u AS (SELECT way, pos, y, x + 360 * round((first_value(x) OVER (PARTITION BY way ORDER BY pos) - x) / 360) AS x, first_value(x) OVER (PARTITION BY way ORDER BY pos) AS rx FROM v WHERE m = size),
e AS (SELECT * FROM (SELECT way, rx, x AS xa, y AS ya, lead(x) OVER (PARTITION BY way ORDER BY pos) AS xb, lead(y) OVER (PARTITION BY way ORDER BY pos) AS yb FROM u) WHERE xb IS NOT NULL),
b AS MATERIALIZED (SELECT way, rx, CASE WHEN ya <= yb THEN xa ELSE xb END AS x0, CASE WHEN ya <= yb THEN xb ELSE xa END AS x1, least(ya, yb) AS y0, greatest(ya, yb) AS y1 FROM e),
box AS MATERIALIZED (SELECT way, rx, min(y0) AS s, max(y1) AS n, min(least(x0, x1)) AS w, max(greatest(x0, x1)) AS e FROM b GROUP BY way, rx),
c AS MATERIALIZED (SELECT n.id, box.way, lat AS py, lon + 360 * round((rx - lon) / 360) AS px FROM box JOIN n ON lat BETWEEN s AND n AND lon + 360 * round((rx - lon) / 360) BETWEEN w AND e),
t AS (SELECT id, c.way, py, px, x0, x1, y0, y1, (px - x0) * (y1 - y0) - (x1 - x0) * (py - y0) AS turn FROM c JOIN b ON b.way = c.way) """

def _snapshots_sql() -> str:
    """The report over the rows that had arrived by the end of each span."""
    ends = "b AS MATERIALIZED (SELECT min(epoch_us(loaded_at)) AS lo, max(epoch_us(loaded_at)) AS hi FROM (SELECT loaded_at FROM nodes UNION ALL SELECT loaded_at FROM ways UNION ALL SELECT loaded_at FROM relations))"
    parts = [f"WITH {ends}"]
    for i in range(SNAPSHOTS):
        by = f"loaded_at IS NULL OR epoch_us(loaded_at) < (SELECT lo + (hi + 1 - lo) * {i + 1} // {SNAPSHOTS} FROM b)"
        parts += [f"{t}{i} AS MATERIALIZED (SELECT * FROM {t} WHERE {by})" for t in ("nodes", "ways", "relations")]
    one = []
    for i in range(SNAPSHOTS):
        sql = _P1
        for t in ("nodes", "ways", "relations"):
            sql = sql.replace(f"FROM {t}", f"FROM {t}{i}")
        one.append(f"SELECT {i} AS snapshot, * FROM ({sql} SELECT kind, type, strftime(ts, '%Y-%m') AS month, count(*) AS n_refs FROM o GROUP BY ALL)")
    return ", ".join(parts) + " " + " UNION ALL ".join(one)


SQL = {
    "p1_snapshots": _snapshots_sql(),
    "p5_regions": _P5R + "SELECT id, way AS way_id FROM t GROUP BY id, way HAVING count(CASE WHEN y0 <= py AND py < y1 AND turn < 0 THEN 1 END) % 2 = 1 OR bool_or(py BETWEEN y0 AND y1 AND px BETWEEN least(x0, x1) AND greatest(x0, x1) AND abs(turn) <= 1e-12)",
    "p1_found": _P1 + "SELECT kind, id, pos, ref FROM o",
    "p1_report": _P1 + "SELECT kind, type, strftime(ts, '%Y-%m') AS month, count(*) AS n_refs FROM o GROUP BY ALL",
    "p2_found": _P2 + """SELECT id, root_id, depth, path FROM up
UNION ALL SELECT n.id, c.least, CASE WHEN r.id IS NOT NULL THEN -1 ELSE -2 END, '' FROM n ANTI JOIN up USING (id) JOIN reach c USING (id) LEFT JOIN ring r ON r.id = n.id""",
    "p2_descendants": _P2 + "SELECT u.id::BIGINT AS id, x.id AS descendant, x.depth - u.pos AS distance FROM up x, (SELECT id AS d, unnest(string_split(path, '/')) AS id, generate_subscripts(string_split(path, '/'), 1) - 1 AS pos FROM up) u WHERE u.d = x.id AND u.pos < x.depth",
    "p5_found": f"""WITH p AS MATERIALIZED (SELECT id, lat, lon, floor((lat + 90) * 8000)::BIGINT AS s, floor((lon + 180) * 20)::BIGINT % 7200 AS c FROM ({_CURRENT.format(t="nodes")})
  WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0)),
q AS (SELECT id, lat, lon, s + ds AS s, (c + dc + 7200) % 7200 AS c FROM p, (VALUES (-1), (0), (1)) a(ds), (VALUES (-1), (0), (1)) b(dc))
SELECT x.id AS id_a, y.id AS id_b FROM p x JOIN q y ON x.s = y.s AND x.c = y.c AND x.id < y.id
WHERE 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) <= 10.0""",
}
