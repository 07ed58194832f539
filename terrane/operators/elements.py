"""Nodes, ways and relations: scans of current rows, way geometry, relation roll-up, block statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators.ranking import ranked
from terrane.operators.versions import current


def nodes(table: DataFrame) -> DataFrame:
    """(id, lat, lon) of live nodes, in degrees, as stored."""
    return current(table, ["lat", "lon"])


def fixed_nodes(table: DataFrame) -> DataFrame:
    """(id, lat, lon) of live nodes with a valid position, in fixed point."""
    ok = nodes(table).filter(geo.valid(F.col("lat"), F.col("lon")))
    return ok.select("id", geo.to_fixed(F.col("lat")).alias("lat"), geo.to_fixed(F.col("lon")).alias("lon"))


def ways(table: DataFrame) -> DataFrame:
    return current(table, ["refs"])


def way_refs(table: DataFrame) -> DataFrame:
    """(way_id, pos, node_id): the references of live ways in order; null elements keep their place and are left out."""
    return ways(table).select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id")).filter(F.col("node_id").isNotNull())


def relations(table: DataFrame) -> DataFrame:
    return current(table, ["members"])


def members(table: DataFrame) -> DataFrame:
    """(rel_id, pos, type, ref, role) of live relations."""
    m = relations(table).select(F.col("id").alias("rel_id"), F.posexplode("members").alias("pos", "m"))
    return m.select("rel_id", "pos", F.col("m.type").cast("int").alias("type"), F.col("m.ref").alias("ref"), F.col("m.role").alias("role"))


def way_geometry(way_table: DataFrame, node_table: DataFrame, on_missing: str = "drop") -> DataFrame:
    """(way_id, pos, node_id, lat, lon): each vertex of each way, repeats kept.

    ``on_missing``: what becomes of references to nodes without a valid position: ``drop``, ``null`` or ``error``.
    """
    n = fixed_nodes(node_table).withColumnRenamed("id", "node_id")
    refs = way_refs(way_table)
    if on_missing == "drop":
        return refs.join(n, "node_id").select("way_id", "pos", "node_id", "lat", "lon")
    out = refs.join(n, "node_id", "left").select("way_id", "pos", "node_id", "lat", "lon")
    if on_missing == "error":
        text = F.concat(F.lit("way "), F.col("way_id").cast("string"), F.lit(" names a node without position: "), F.col("node_id").cast("string"))
        return out.withColumn("lat", F.when(F.col("lat").isNull(), F.raise_error(text).cast("int")).otherwise(F.col("lat")))
    if on_missing != "null":
        raise ValueError(on_missing)
    return out


def _mid(c: str):
    return (F.sum(F.col(c).cast("bigint")).cast("double") / F.count(F.lit(1))).cast("int").alias(f"mid_{c}")


def way_geometry_stats(geometry: DataFrame) -> DataFrame:
    """(way_id, n_nodes, bounds, mid_lat, mid_lon) of ways with at least one vertex; no geometry is collected."""
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)]
    return geometry.groupBy("way_id").agg(F.count(F.lit(1)).alias("n_nodes"), *bounds, _mid("lat"), _mid("lon"))


def way_info(way_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """:func:`way_geometry_stats` of all live ways; those without vertices have 0 nodes and null bounds."""
    stats = way_geometry_stats(way_geometry(way_table, node_table))
    return ways(way_table).select(F.col("id").alias("way_id")).join(stats, "way_id", "left").withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0)).cast("bigint"))


def vertex_jumps(geometry: DataFrame) -> DataFrame:
    """(way_id, pos, diff): the change of latitude to the vertex before."""
    w = Window.partitionBy("way_id").orderBy("pos")
    diff = F.abs(F.col("lat").cast("bigint") - F.lag("lat").over(w).cast("bigint"))
    return geometry.select("way_id", "pos", diff.alias("diff")).filter(F.col("diff").isNotNull())


def relation_members(relation_table: DataFrame, node_table: DataFrame, way_table: DataFrame) -> DataFrame:
    """(rel_id, pos, type, ref, role, mid_lat, mid_lon, bounds): node and way members resolved, the rest null."""
    n = fixed_nodes(node_table).select(F.lit(0).alias("type"), F.col("id").alias("ref"), *[F.col(c).alias(f"{f}_{c}") for c in ("lat", "lon") for f in ("min", "max")], F.col("lat").alias("mid_lat"), F.col("lon").alias("mid_lon"))
    m = members(relation_table)
    named = m.filter("type = 1").select(F.col("ref").alias("way_id")).distinct()
    # only ways that relations name are assembled
    refs = way_refs(way_table).join(named, "way_id", "left_semi")
    geometry = refs.join(fixed_nodes(node_table).withColumnRenamed("id", "node_id"), "node_id")
    w = way_geometry_stats(geometry).drop("n_nodes").withColumnRenamed("way_id", "ref").withColumn("type", F.lit(1)).select(*n.columns)
    return m.join(n.unionByName(w), ["type", "ref"], "left").select("rel_id", "pos", "type", "ref", "role", "mid_lat", "mid_lon", "min_lat", "max_lat", "min_lon", "max_lon")


def relation_bbox(resolved: DataFrame) -> DataFrame:
    """(rel_id, n_members, n_resolved, bounds) of relations with members."""
    bounds = [F.min(f"min_{c}").alias(f"min_{c}") for c in ("lat", "lon")] + [F.max(f"max_{c}").alias(f"max_{c}") for c in ("lat", "lon")]
    return resolved.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n_members"), F.count("mid_lat").alias("n_resolved"), *bounds)


def role_dictionary(relation_table: DataFrame) -> DataFrame:
    """(role, role_id): ids from 0 by first appearance in order of relation and place."""
    first = members(relation_table).filter(F.col("role").isNotNull()).groupBy("role").agg(F.min(F.struct("rel_id", "pos")).alias("first"))
    first = first.select("role", F.col("first.rel_id").alias("rel_id"), F.col("first.pos").alias("pos"))
    return ranked(first, F.shiftright("rel_id", 12), ["rel_id", "pos"], name="role_id").select("role", "role_id")


def block_stats(tables: dict[int, DataFrame], size: int = 8000) -> DataFrame:
    """(blob_no, nodes_count, min_node_id, max_node_id, ways_count, relations_count) of blocks of ``size`` ids."""
    parts = [df.filter(F.col("id").isNotNull()).select(F.lit(kind).alias("kind"), "id") for kind, df in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    rows = rows.withColumn("blob_no", F.shiftleft(F.col("kind").cast("bigint"), 40) + F.floor(F.col("id") / size))
    node = F.when(F.col("kind") == 0, F.col("id"))
    return rows.groupBy("blob_no").agg(F.count(node).alias("nodes_count"), F.min(node).alias("min_node_id"), F.max(node).alias("max_node_id"), F.count(F.when(F.col("kind") == 1, 1)).alias("ways_count"), F.count(F.when(F.col("kind") == 2, 1)).alias("relations_count"))


def map_objects(node_table: DataFrame, way_table: DataFrame, relation_table: DataFrame) -> DataFrame:
    """(kind, id, mid_lat, mid_lon, weight): everything that has a place; a way weighs one more than its vertices."""
    n = fixed_nodes(node_table).select(F.lit(0).alias("kind"), "id", F.col("lat").alias("mid_lat"), F.col("lon").alias("mid_lon"), F.lit(1).cast("bigint").alias("weight"))
    w = way_geometry_stats(way_geometry(way_table, node_table)).select(F.lit(1).alias("kind"), F.col("way_id").alias("id"), "mid_lat", "mid_lon", (F.col("n_nodes") + 1).alias("weight"))
    centre = lambda c: F.floor((F.col(f"min_{c}").cast("bigint") + F.col(f"max_{c}").cast("bigint")) / 2).cast("int").alias(f"mid_{c}")
    r = relation_bbox(relation_members(relation_table, node_table, way_table)).filter("n_resolved > 0").select(F.lit(2).alias("kind"), F.col("rel_id").alias("id"), centre("lat"), centre("lon"), F.lit(1).cast("bigint").alias("weight"))
    return n.unionByName(w).unionByName(r)
