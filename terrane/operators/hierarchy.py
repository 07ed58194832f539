"""Parent-child links to full hierarchies by tree contraction.

Links (child, parent) form trees of unknown depth, or circles with trees below them. Each round rakes all leaves (nodes
with a parent and no child) and compresses unary chains: a node with one child is spliced out if it draws a lower number
in the round than its parent and its child, and its child's link then leads past it. Every link carries the ids it stands
for. A constant share of the nodes goes in each round, whatever the shape, so rounds grow with the logarithm of the
number of nodes. What no round can remove are the circles: they shrink to a node linked to itself.

The recorded contractions are then reversed, last round first: the end of each is resolved by then, and gives its root,
depth and path to the node, with the carried ids put between. Nodes removed under a circle are on it if the child they
had is, else below.

Each round is a handful of joins and aggregates on the ids, written by one job that also counts the links left; links and
records are tables in the shared folder, and the driver sees only counts. Links shrink by a constant share a round, and
results grow by as much a reversed round, so that all rounds together read a small multiple of the links. A parent of a third of all nodes is pre-aggregated when children are counted, and raked
children aren't joined with it until the end, where its side of the join is a single row.

Defined results: links with a null end are none; repeated links count once; of several parents of a child the least id
is kept; a node linked to itself is a circle; an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terrane.session import materialize, release, together

ON_CIRCLE, BELOW_CIRCLE = -1, -2


def _union(parts: list[DataFrame]) -> DataFrame:
    """Tables of one schema as one scan."""
    return together(parts) if len(parts) > 1 else parts[0]


def _draw(c: str, i: int):
    return F.xxhash64(F.col(c), F.lit(i))


def _round(links: DataFrame, i: int) -> tuple[DataFrame, DataFrame, int]:
    """One round: (records, links, number of links left): rows (kind, v, p, ids, n, least, child); kind 0 raked, 1 spliced, 2 circle, 3 link."""
    children = links.groupBy(F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("child"))
    kind = F.when(F.col("m").isNull(), 0).when((F.col("m") == 1) & (_draw("v", i) < _draw("p", i)) & (_draw("v", i) < _draw("child", i)), 1).otherwise(3)
    marked = links.join(children, "v", "left").select("v", "p", "ids", "n", "least", "child", kind.alias("kind"))
    # a spliced node's parent isn't spliced, and a raked one's link stays: only links that stay are led past
    past = marked.filter("kind = 1").select(F.col("v").alias("p"), F.col("p").alias("up"), F.col("ids").alias("ids_up"), F.col("n").alias("n_up"), F.col("least").alias("least_up"))
    moved = (F.col("kind") == 3) & F.col("up").isNotNull()
    end = F.when(moved, F.col("up")).otherwise(F.col("p"))
    circle = (F.col("kind") == 3) & (end == F.col("v"))
    left = Observation()
    rows = materialize(
        marked.join(past, "p", "left")
        .select(
            F.when(circle, 2).otherwise(F.col("kind")).alias("kind"), "v", end.alias("p"),
            F.when(circle, None).when(moved, F.concat_ws("/", "ids_up", "ids")).otherwise(F.col("ids")).alias("ids"),
            F.when(moved, F.col("n") + F.col("n_up")).otherwise(F.col("n")).alias("n"),
            F.when(moved, F.least("least", "least_up")).otherwise(F.col("least")).alias("least"), "child",
        )
        .observe(left, F.count(F.when(F.col("kind") == 3, 1)).alias("n"))
    )
    return rows, rows.filter("kind = 3").select("v", "p", "ids", "n", "least"), left.get["n"]


def _resolve(record: DataFrame, known: DataFrame, spliced: bool) -> DataFrame:
    """The results of removed nodes whose ends are known."""
    end = known.select(F.col("id").alias("p"), "root_id", F.col("depth").alias("d"), F.col("path").alias("up"))
    record = record.join(end, "p")
    if spliced:  # on a circle if the child it had is; what was raked never is
        record = record.join(known.filter(F.col("depth") == ON_CIRCLE).select(F.col("id").alias("child"), F.lit(True).alias("ring")), "child", "left")
    else:
        record = record.withColumn("ring", F.lit(False))
    depth = F.when(F.col("d") >= 0, F.col("d") + F.col("n")).when(F.col("ring"), ON_CIRCLE).otherwise(BELOW_CIRCLE)
    path = F.when(F.col("d") >= 0, F.concat_ws("/", "up", "ids")).otherwise("")
    return record.select(F.col("v").alias("id"), "root_id", depth.cast("bigint").alias("depth"), path.alias("path"))


def hierarchies(links: DataFrame) -> DataFrame:
    """(id, root_id, depth, path) of each node with a link, from ``links`` (child bigint, parent bigint).

    On a circle: the least id of the circle, -1 and an empty path; below one: likewise, with depth -2.
    """
    links = links.filter(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy("child").agg(F.min("parent").alias("parent"))
    base = materialize(links.select(F.col("child").alias("v"), F.col("parent").alias("p")))
    text = F.col("v").cast("string").alias("ids")
    loops = base.filter("v = p")
    active = base.filter("v <> p").select("v", "p", text, F.lit(1).cast("bigint").alias("n"), F.col("v").alias("least"))
    rounds, left = [], active.count()
    while left:
        rows, active, left = _round(active, len(rounds))
        rounds.append(rows)
    tops = base.select("p").distinct().join(base.select(F.col("v").alias("p")), "p", "left_anti").select(F.col("p").alias("id"), F.col("p").alias("root_id"), F.lit(0).cast("bigint").alias("depth"), F.col("p").cast("string").alias("path"))
    circles = loops.select("v", F.col("v").alias("least"))
    for rows in rounds:
        circles = circles.unionAll(rows.filter("kind = 2").select("v", "least"))
    parts = [materialize(tops.unionAll(circles.select("v", "least", F.lit(ON_CIRCLE).cast("bigint"), F.lit(""))))]
    for rows in reversed(rounds):
        # a leaf may have been raked from a node that was spliced in the same round
        known = _union(parts)
        spliced = _resolve(rows.filter("kind = 1"), known, True)
        parts.append(materialize(spliced.unionAll(_resolve(rows.filter("kind = 0"), known.unionAll(spliced), False))))
        release(rows)
    release(base)
    return _union(parts).select("id", "root_id", F.col("depth").cast("int").alias("depth"), "path")


def descendants(trees: DataFrame) -> DataFrame:
    """(id, descendant, distance): all descendants of each node in a tree, from the result of :func:`hierarchies`."""
    above = trees.filter("depth > 0").select(F.col("id").alias("descendant"), "depth", F.posexplode(F.split("path", "/")).alias("at", "up"))
    return above.filter(F.col("at") < F.col("depth")).select(F.col("up").cast("bigint").alias("id"), "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def relation_links(relations: DataFrame) -> DataFrame:
    """(child, parent) between live relations, from the ``members`` of their current rows."""
    from terrane.operators.versions import current

    now = materialize(current(relations, ["members"]).select("id", F.transform(F.filter("members", lambda m: m["type"] == 2), lambda m: m["ref"]).alias("refs")))
    named = now.select(F.col("id").alias("parent"), F.explode("refs").alias("child")).filter(F.col("child").isNotNull()).distinct()
    return named.join(now.select(F.col("id").alias("child")), "child", "left_semi").select("child", "parent")
