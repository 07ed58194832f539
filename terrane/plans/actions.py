"""Named actions over an extract or a folder of tables: ``python -m terrane ACTION INPUT OUTPUT``."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators import elements, spatial, tags
from terrane.sources import sinks

Tables = dict[str, DataFrame]
ACTIONS: dict[str, Callable[[Tables, str], None]] = {}


def action(name: str):
    def add(f):
        ACTIONS[name] = f
        return f

    return add


def read_tables(spark: SparkSession, path: str) -> Tables:
    """nodes, ways, relations and tags from an extract (.pbf) or from Parquet tables of these names."""
    if path.endswith(".pbf"):
        from terrane.sources.pbf.source import tables

        return tables(spark, path)
    return {t: spark.read.parquet(os.path.join(path, f"{t}.parquet")) for t in ("nodes", "ways", "relations", "tags")}


@action("blob-index")
def blob_index(t: Tables, out: str) -> None:
    sinks.write(elements.block_stats({0: t["nodes"], 1: t["ways"], 2: t["relations"]}), f"{out}/blob_stats")


@action("nodes-index")
def nodes_index(t: Tables, out: str) -> None:
    n = elements.fixed_nodes(t["nodes"])
    sinks.write_by_place(n.withColumn("morton", geo.morton(F.col("lat"), F.col("lon"))), f"{out}/morton")


@action("join")
def join(t: Tables, out: str, codes: tags.Codes = tags.Codes(), limit: int = 10_000) -> None:
    """Node and way tables sorted by id, way classes, encoded tags, and the kd-tree of all objects."""
    sinks.write_by_id(elements.fixed_nodes(t["nodes"]), f"{out}/nodes")
    geometry = elements.way_geometry(t["ways"], t["nodes"])
    sinks.write_by_id(geometry.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", "lat", "lon"))).alias("nodes")), f"{out}/way_geom", "way_id")
    sinks.write_by_id(elements.way_info(t["ways"], t["nodes"]).join(tags.way_class(elements.ways(t["ways"]).select("id"), t["tags"]), "way_id"), f"{out}/way_info", "way_id")
    sinks.write(tags.checked(tags.encode(t["tags"].filter("kind = 0"), codes, "node").unionByName(tags.encode(t["tags"].filter("kind = 1"), codes, "way"))), f"{out}/tags", ["kind"])
    rows, tree = spatial.kd_tree(elements.map_objects(t["nodes"], t["ways"], t["relations"]), limit)
    sinks.write_leaves(rows, f"{out}/leaves")
    sinks.write(tree, f"{out}/kd_split")


@action("heat-map")
def heat_map(t: Tables, out: str) -> None:
    row, col = geo.heat_bin(F.col("lat"), F.col("lon"))
    sinks.write(elements.fixed_nodes(t["nodes"]).groupBy(row.alias("lat_bin"), col.alias("lon_bin")).agg(F.count(F.lit(1)).alias("cnt")), f"{out}/heat_map")


@action("tags")
def postings(t: Tables, out: str) -> None:
    sinks.write(tags.surrogate_ids(t["tags"], "k", "key_id"), f"{out}/keys")
    sinks.write(tags.surrogate_ids(t["tags"], "v", "value_id"), f"{out}/values")
    sinks.write(tags.postings(t["tags"], ["k"], True, True), f"{out}/key_postings")
    sinks.write(tags.postings(t["tags"], ["v"], False, False), f"{out}/value_postings")
    sinks.write(tags.postings(t["tags"], ["k", "v"], False, False), f"{out}/key_value_postings")


@action("spatial")
def partition(t: Tables, out: str, limit: int = 10_000) -> None:
    n = elements.fixed_nodes(t["nodes"]).select(F.lit(0).alias("kind"), "id", F.col("lat").alias("mid_lat"), F.col("lon").alias("mid_lon"), F.lit(1).cast("bigint").alias("weight"))
    rows, tree = spatial.kd_tree(n, limit)
    sinks.write_leaves(rows, f"{out}/leaves")
    sinks.write(tree, f"{out}/kd_split")


@action("ways-file")
def ways_file(t: Tables, out: str) -> None:
    info = elements.way_info(t["ways"], t["nodes"])
    sinks.write(info.agg(F.count(F.lit(1)).alias("n_ways"), F.max("n_nodes").alias("max_nodes"), F.avg("n_nodes").alias("mean_nodes")), f"{out}/way_stats")
    sinks.write(info.filter("n_nodes < 80").groupBy("n_nodes").agg(F.count(F.lit(1)).alias("cnt")), f"{out}/way_len_hist")


@action("merge-rel")
def merge_relations(t: Tables, out: str) -> None:
    resolved = elements.relation_members(t["relations"], t["nodes"], t["ways"])
    sinks.write(resolved, f"{out}/relation_members")
    sinks.write(elements.relation_bbox(resolved), f"{out}/relation_bbox")
    sinks.write(elements.role_dictionary(t["relations"]), f"{out}/roles")


@action("tags-stat")
def tag_stats(t: Tables, out: str) -> None:
    sinks.write(tags.key_counts(t["tags"]), f"{out}/tag_stats", ["kind"])


def run(spark: SparkSession, name: str, source: str, out: str) -> None:
    if name not in ACTIONS:
        raise ValueError(f"action {name!r} is none of {', '.join(ACTIONS)}")
    ACTIONS[name](read_tables(spark, source), out)
