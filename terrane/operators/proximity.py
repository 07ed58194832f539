"""Points near points, and points in regions, by crossing parity.

Regions: the edges of each polygon are binned into latitude strips of a fixed height, cut along the longitude into cells of
about that height, on a grid that fits the polygon's extent and number of edges. A ray from a point to the east crosses an
edge if the edge spans its latitude (lower end included, upper not) and passes east of it; an odd number of crossings
means that the point is inside. A ray needn't leave its cell: it is followed to the cell's east side and up to the corner
there, over edges of that cell alone, and the corner's own parity is known for each cell from the strip's upper line. So a
cell without edges is one row, inside as a whole or not listed, and a point meets the edges of its own cell only,
whatever the region's size. Points on an edge are inside (``boundary=True``) or outside, tested by themselves.

Points near a point are those in the region around it: a box that holds the whole circle, whose members then pass the
exact great-circle test.

Defined results: points with null, not-a-number or impossible coordinates and those at exactly (0, 0) are in no pair;
longitudes -180 and 180 are one meridian, and near a pole the box spans all longitudes; points at one place are pairs; an
empty table gives no pairs. Cells of more than ``dense`` points are cut into 16; those that hold more than ``hot`` points
are salted: their points are spread over tasks, and the regions of such a cell are sent to each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import materialize, release

RADIUS_M = 6_371_000.0
CELL_M = 100.0
DENSE, PARTS = 64, 4
ACROSS = 16.0
HOT = 4096


def usable(lat: Column, lon: Column) -> Column:
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(ok & ~((lat == 0.0) & (lon == 0.0)), F.lit(False))


def great_circle_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    p, q = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


class Grid:
    """Strips of ``height`` degrees of latitude; each has as many cells as fit at its end nearer to a pole."""

    def __init__(self, height: float | Column):
        self.height = height

    def strip(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / self.height)

    def columns(self, strip: Column) -> Column:
        far = F.greatest(F.abs(strip * self.height - 90.0), F.abs((strip + 1) * self.height - 90.0))
        return F.greatest(F.floor(360.0 * F.cos(F.radians(F.least(far, F.lit(90.0)))) / self.height), F.lit(1))

    def column(self, lon: Column, n: Column) -> Column:
        """Not yet wrapped around."""
        return F.floor((lon + 180.0) / 360.0 * n)

    @staticmethod
    def cell(strip: Column, column: Column, n: Column) -> Column:
        return strip * (1 << 32) + F.pmod(column, n)

    def of(self, lat: Column, lon: Column) -> Column:
        n = self.columns(self.strip(lat))
        return self.cell(self.strip(lat), self.column(lon, n), n)

    def part(self, lat: Column, lon: Column, strip: Column, column: Column, n: Column) -> tuple[Column, Column]:
        """The place within a cell of ``PARTS`` by ``PARTS`` parts; what lies beyond the cell is at its rim."""
        inside = lambda x: F.greatest(F.least(F.floor(x * PARTS), F.lit(PARTS - 1)), F.lit(0))
        return inside((lat + 90.0) / self.height - strip), inside((lon + 180.0) / 360.0 * n - column)

    def cover(self, df: DataFrame, south: Column, north: Column, west: Column, east: Column) -> DataFrame:
        """``df`` with ``cell``: a row for each cell that meets the rectangle (east may exceed 180, west -180), with
        ``parts``: of its parts the first and last that do, in both directions."""
        df = df.withColumn("_strip", F.explode(F.sequence(self.strip(south), self.strip(north)))).withColumn("_n", self.columns(F.col("_strip")))
        first, last = self.column(west, F.col("_n")), self.column(east, F.col("_n"))
        df = df.withColumn("_c", F.explode(F.sequence(first, F.least(last, first + F.col("_n") - 1)))).withColumn("cell", self.cell(F.col("_strip"), F.col("_c"), F.col("_n")))
        whole = east - west >= 360.0
        (a, c), (b, d) = (self.part(y, x, F.col("_strip"), F.col("_c"), F.col("_n")) for y, x in ((south, west), (north, east)))
        return df.withColumn("parts", F.array(a, b, F.when(whole, 0).otherwise(c), F.when(whole, PARTS - 1).otherwise(d))).drop("_strip", "_n", "_c")


def crossings(points: DataFrame, edges: DataFrame, on: list[str], carry: list[str], also: Column | None = None) -> DataFrame:
    """(``on``, rid, pid, ``carry``, crossings): how many edges of a region a point's ray crosses, where it does.

    points: ``on``, pid, py, px. edges: ``on``, rid, rx (a longitude of the ring, which fixes the turn of the globe),
    y0 < y1, x0, x1. All edges of a ring that a ray from a cell may meet are in that cell, so counting stays in it.
    """
    x = F.col("px") + 360.0 * F.round((F.col("rx") - F.col("px")) / 360.0)
    at = F.col("x0") + (F.col("x1") - F.col("x0")) * ((F.col("py") - F.col("y0")) / (F.col("y1") - F.col("y0")))
    crosses = (F.col("y0") <= F.col("py")) & (F.col("py") < F.col("y1")) & (x < at)
    joined = edges.join(points, on).filter(crosses if also is None else crosses & also)
    return joined.groupBy(*on, "rid", "pid", *carry).agg(F.count(F.lit(1)).alias("crossings"))


def _crowded(cells: DataFrame, on: list[str], most: int) -> DataFrame | None:
    """(``on``, salts) of the cells with more than ``most`` points, one salt for each ``most``; None if there is none."""
    found = materialize(cells.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).cast("int").alias("salts")))
    if found.isEmpty():
        release(found)
        return None
    return found


def _salted(points: DataFrame, regions: DataFrame, on: list[str], hot: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points of crowded cells spread over salts, the regions of these sent to each."""
    found = _crowded(points.select(*on), on, hot)
    if found is None:
        return points, regions, on
    points = points.join(found, on, "left").withColumn("salt", F.pmod(F.xxhash64("pid"), F.coalesce("salts", F.lit(1)))).drop("salts")
    regions = regions.join(found, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)).cast("bigint") - 1))).drop("salts")
    return points, regions, [*on, "salt"]


def pairs_within(points: DataFrame, metres: float, cell_m: float = CELL_M, hot: int = HOT, dense: int = DENSE) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of ``points`` (unique id, lat, lon) at most ``metres`` apart."""
    degree = RADIUS_M * math.pi / 180
    grid = Grid(max(cell_m, 2 * metres) / degree)
    points = materialize(points.select("id", "lat", "lon").filter(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon"))))

    reach = metres / degree * (1 + 1e-6) + 1e-9
    lat, lon = F.col("ry"), F.col("rx")
    wide = F.degrees(F.asin(F.least(F.sin(F.lit(math.radians(reach))) / F.cos(F.radians(lat)), F.lit(1.0)))) * (1 + 1e-6) + 1e-9
    wide = F.when(F.abs(lat) + reach >= 90.0, F.lit(181.0)).otherwise(wide)

    place = grid.strip(F.col("lat")), grid.column(F.col("lon"), grid.columns(grid.strip(F.col("lat")))), grid.columns(grid.strip(F.col("lat")))
    p = points.select(grid.of(F.col("lat"), F.col("lon")).alias("cell"), F.col("id").alias("pid"), F.col("lat").alias("py"), F.col("lon").alias("px"), F.array(*grid.part(F.col("lat"), F.col("lon"), *place)).alias("parts"))
    r = points.select(F.col("id").alias("rid"), F.col("lat").alias("ry"), F.col("lon").alias("rx"))
    r = grid.cover(r, F.greatest(lat - reach, F.lit(-90.0)), F.least(lat + reach, F.lit(90.0)), lon - wide, lon + wide)
    on = ["cell"]
    if (found := _crowded(p.select("cell"), on, dense)) is not None:
        # as towns fill up, their cells are cut, so that candidates grow with the pairs and not with the square of density
        on = ["cell", "part"]
        each = lambda i: F.sequence(F.col("parts")[i], F.col("parts")[i + 1])
        all_parts = F.flatten(F.transform(each(0), lambda y: F.transform(each(2), lambda x: y * PARTS + x)))
        p = p.join(found, "cell", "left").withColumn("part", F.when(F.col("salts").isNull(), 0).otherwise(F.col("parts")[0] * PARTS + F.col("parts")[1])).drop("salts")
        r = r.join(found, "cell", "left").withColumn("part", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(all_parts))).drop("salts")
    p, r, on = _salted(p.drop("parts"), r.drop("parts"), on, hot)
    # regions travel as one row; their edges (the two that aren't parallel to a ray) are made where they arrive
    sides = F.array(*[F.struct((lat - reach).alias("y0"), (lat + reach).alias("y1"), x.alias("x0"), x.alias("x1")) for x in (lon - wide, lon + wide)])
    edges = r.repartition(*on).select(*on, "rid", "ry", "rx", F.inline(sides))
    inside = crossings(p, edges, on, ["ry", "rx", "py", "px"], F.col("rid") < F.col("pid")).filter(F.col("crossings") % 2 == 1)
    near = great_circle_m(F.col("ry"), F.col("rx"), F.col("py"), F.col("px")) <= metres
    return inside.filter(near).select(F.col("rid").alias("id_a"), F.col("pid").alias("id_b"))


def containing_regions(points: DataFrame, rings: DataFrame, cell_deg: float = 0.001, boundary: bool = True, hot: int = HOT) -> DataFrame:
    """(id, region): each region that holds a point.

    A ring's cells are of ``cell_deg`` degrees times the least power of 4 by which about twice the root of its number of
    edges go across it, or ``ACROSS``, so that the cells inside it are no more than its edges in order of size, or 256.

    points: id, lat, lon. rings: region, ring (array of struct(lat, lon)), closed or not; several rings of one region
    (holes, parts) go by the even-odd rule. Successive vertices are joined the short way, so that rings may cross the
    180th meridian; rings around a pole aren't supported. Rings of fewer than three places or with unusable vertices
    hold nothing but the points on them.
    """
    c = F.col
    points = points.select("id", "lat", "lon").filter(c("id").isNotNull() & usable(c("lat"), c("lon")))

    ring = F.filter("ring", lambda v: v.isNotNull() & usable(v["lat"], v["lon"]))
    rings = rings.filter(c("region").isNotNull()).select(c("region").alias("rid"), ring.alias("ring")).filter(F.size("ring") > 0)
    rings = rings.withColumn("rx", F.element_at("ring", 1)["lon"])
    # unroll: every longitude within half a turn of the ring's first
    rings = rings.withColumn("ring", F.transform("ring", lambda v: F.struct(v["lat"].alias("y"), (v["lon"] + 360.0 * F.round((c("rx") - v["lon"]) / 360.0)).alias("x"))))
    end = lambda f, a: f(F.transform("ring", lambda v: v[a]))
    extent = F.greatest(end(F.array_max, "x") - end(F.array_min, "x"), end(F.array_max, "y") - end(F.array_min, "y"))
    size = F.greatest(extent / F.greatest(2 * F.sqrt(F.size("ring").cast("double")), F.lit(ACROSS)), F.lit(cell_deg))
    rings = materialize(rings.withColumn("level", F.ceil(F.log(size / cell_deg) / math.log(4) - 1e-9).cast("int")))
    levels = sorted(r["level"] for r in rings.select("level").distinct().collect())  # at most a dozen
    grid = Grid(F.lit(cell_deg) * F.pow(F.lit(4.0), c("level")))
    p = points.select(F.explode(F.lit(levels).cast("array<int>")).alias("level"), c("id").alias("pid"), c("lat").alias("py"), F.when(c("lon") == 180.0, -180.0).otherwise(c("lon")).alias("px"))
    p = p.withColumn("cell", grid.of(c("py"), c("px")))

    closed = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    edges = rings.select("rid", "rx", "level", F.inline(F.zip_with("ring", closed, lambda a, b: F.struct(a["y"].alias("ya"), a["x"].alias("xa"), b["y"].alias("yb"), b["x"].alias("xb")))))
    up = c("ya") <= c("yb")
    edges = edges.select("rid", "rx", "level", F.least("ya", "yb").alias("y0"), F.greatest("ya", "yb").alias("y1"), F.when(up, c("xa")).otherwise(c("xb")).alias("x0"), F.when(up, c("xb")).otherwise(c("xa")).alias("x1"))
    strips = edges.withColumn("strip", F.explode(F.sequence(F.greatest(F.ceil((c("y0") + 90.0) / grid.height) - 1, F.lit(0)), grid.strip(c("y1")))))
    strips = strips.withColumn("n", grid.columns(c("strip"))).withColumn("top", (c("strip") + 1) * grid.height - 90.0)
    side = lambda column: (column + 1) * 360.0 / c("n") - 180.0  # noqa: E731  # the east side of a column
    turn = lambda x, y: (x - c("x0")) * (c("y1") - c("y0")) - (c("x1") - c("x0")) * (y - c("y0"))  # noqa: E731  # not positive: the edge passes east of (x, y), or through it

    # corners: an edge over the strip's upper line is east of the corners of all columns up to one; between each two of a region they are inside
    at = c("x0") + (c("x1") - c("x0")) * ((c("top") - c("y0")) / (c("y1") - c("y0")))
    near = strips.filter((c("y0") <= c("top")) & (c("top") < c("y1"))).withColumn("near", grid.column(at, c("n")) - 1)
    upto = F.when(turn(side(c("near") + 1), c("top")) <= 0, c("near") + 1).when(turn(side(c("near")), c("top")) <= 0, c("near")).otherwise(c("near") - 1)
    line = Window.partitionBy("level", "rid", "rx", "strip").orderBy(F.desc("upto"))
    odd = near.select("level", "rid", "rx", "strip", "n", upto.alias("upto")).withColumn("i", F.row_number().over(line)).withColumn("after", F.lead("upto").over(line))
    odd = odd.filter((c("i") % 2 == 1) & (c("after") < c("upto"))).withColumn("column", F.explode(F.sequence(c("after") + 1, c("upto"))))
    covered = odd.select("level", "rid", grid.cell(c("strip"), c("column"), c("n")).alias("cell"))

    # edges by the cells they pass; cells too many do no harm
    part = lambda y: F.when(c("y1") > c("y0"), c("x0") + (c("x1") - c("x0")) * ((y - c("y0")) / (c("y1") - c("y0"))))
    ends = [F.coalesce(part(F.greatest("y0", c("top") - grid.height)), c("x0")), F.coalesce(part(F.least("y1", "top")), c("x1"))]
    cells = strips.withColumn("column", F.explode(F.sequence(grid.column(F.least(*ends) - 1e-9, c("n")), grid.column(F.greatest(*ends) + 1e-9, c("n")))))
    cells = cells.select("level", "rid", grid.cell(c("strip"), c("column"), c("n")).alias("cell"), "x0", "x1", "y0", "y1", "top", side(c("column")).alias("east"), (360.0 * F.floor(c("column") / c("n"))).alias("round"))

    p, r, on = _salted(p, cells.unionByName(covered, allowMissingColumns=True), ["level", "cell"], hot)
    met = r.join(p, on).withColumn("px", c("px") + F.coalesce("round", F.lit(0.0)))
    slope, one = c("y1") > c("y0"), lambda x: x.cast("int")
    east_low, east_top = turn(c("east"), c("py")) <= 0, turn(c("east"), c("top")) <= 0
    ray = slope & (c("y0") <= c("py")) & (c("py") < c("y1")) & (turn(c("px"), c("py")) < 0) & ~east_low
    rises = F.when(slope, F.when(c("x1") > c("x0"), east_top & ~east_low).otherwise(~east_top & east_low)).otherwise((c("y0") <= c("top")) & (c("y0") > c("py")))
    rises = rises & (F.least("x0", "x1") < c("east")) & (c("east") <= F.greatest("x0", "x1"))
    within = c("py").between(c("y0"), c("y1")) & c("px").between(F.least("x0", "x1"), F.greatest("x0", "x1"))
    found = met.groupBy(c("pid").alias("id"), c("rid").alias("region")).agg(F.sum(F.coalesce(one(ray) + one(rises), F.lit(1))).alias("crossings"), F.max(F.coalesce(within & (F.abs(turn(c("px"), c("py"))) <= 1e-12), F.lit(False))).alias("on_edge"))
    held = (c("crossings") % 2 == 1) | c("on_edge") if boundary else (c("crossings") % 2 == 1) & ~c("on_edge")
    return found.filter(held).select("id", "region")


def way_rings(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(region, ring): the closed ways of four references and more, all to ``nodes`` (id, lat, lon) with a usable position."""
    closed = ways.filter((F.size("refs") >= 4) & (F.element_at("refs", 1) == F.element_at("refs", -1)))
    at = closed.select(F.col("id").alias("region"), F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "id"))
    met = at.join(nodes.filter(usable(F.col("lat"), F.col("lon"))).select("id", "lat", "lon"), "id")
    rings = met.groupBy("region", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))).alias("ring")).filter(F.size("ring") == F.col("n"))
    return rings.select("region", F.transform("ring", lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"))).alias("ring"))
