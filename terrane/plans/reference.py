"""Queries of the geodata operators over nodes, ways, relations and tags, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators import elements, spatial, tags
from terrane.operators.ranking import ranked
from terrane.session import load, materialize, shared_table

CODES = tags.Codes(
    node={("crossing", "uncontrolled"): 1, ("crossing", "marked"): 2},
    way={("building", "yes"): 3, ("building", "house"): 4},
    common={("highway", "residential"): 5, ("highway", "service"): 6, ("landuse", "residential"): 7},
    keys={"building": 10, "highway": 11, "landuse": 12, "surface": 13, "name": 14},
    stop=("name", "source"),
)
SPARSE_STEP, QUANTILES, KD_DEPTH, KD_LIMIT = 50, 50, 3, 10_000


def _t(spark, d, *names):
    return [load(spark, d, n) for n in names]


def node_scan(spark, d):
    """Stored positions; not-a-number is given as null."""
    null = F.lit(None).cast("double")
    return elements.nodes(load(spark, d, "nodes")).select("id", F.nanvl("lat", null).alias("lat"), F.nanvl("lon", null).alias("lon"))


def way_scan(spark, d):
    return elements.way_refs(load(spark, d, "ways"))


def relation_scan(spark, d):
    return elements.members(load(spark, d, "relations"))


def tag_scan(spark, d):
    return load(spark, d, "tags").select(F.col("kind").cast("int").alias("kind"), "id", "k", "v")


def coord_fixed(spark, d):
    return elements.fixed_nodes(load(spark, d, "nodes"))


def coord_degrees(spark, d):
    n = elements.fixed_nodes(load(spark, d, "nodes"))
    return n.select("id", geo.to_degrees(F.col("lat")).alias("lat"), geo.to_degrees(F.col("lon")).alias("lon"))


def morton_code(spark, d):
    n = elements.fixed_nodes(load(spark, d, "nodes"))
    return n.select("id", geo.morton(F.col("lat"), F.col("lon")).alias("morton"))


def morton_sorted(spark, d):
    """All codes in unsigned order: a range partitioning and a sort that spills."""
    return morton_code(spark, d).select("morton").orderBy(geo.unsigned_order(F.col("morton")))


def bbox_contains(spark, d):
    """Vertices of each way that its own bounds contain, the lower bounds not included."""
    g = elements.way_geometry(*_t(spark, d, "ways", "nodes"))
    s = elements.way_geometry_stats(g).drop("n_nodes")
    inside = (F.col("lat") > F.col("min_lat")) & (F.col("lat") <= F.col("max_lat")) & (F.col("lon") > F.col("min_lon")) & (F.col("lon") <= F.col("max_lon"))
    return g.join(s, "way_id").groupBy("way_id").agg(F.count(F.when(inside, 1)).alias("n_inside"))


def way_class(spark, d):
    w, t = _t(spark, d, "ways", "tags")
    return tags.way_class(elements.ways(w).select("id"), t)


def encode_node_tags(spark, d):
    return tags.encode(load(spark, d, "tags").filter("kind = 0"), CODES, "node")


def encode_way_tags(spark, d):
    return tags.encode(load(spark, d, "tags").filter("kind = 1"), CODES, "way")


def encode_common_tags(spark, d):
    return tags.encode(load(spark, d, "tags"), CODES)


def encode_checked(spark, d):
    """The encoded tags of nodes, by code tables that are joined, with each row's shape checked."""
    return tags.checked(tags.encode(load(spark, d, "tags").filter("kind = 0"), CODES, "node", literals=0))


def key_ids(spark, d):
    return tags.surrogate_ids(load(spark, d, "tags"), "k", "key_id")


def value_ids(spark, d):
    return tags.surrogate_ids(load(spark, d, "tags"), "v", "value_id")


def tag_stoplist(spark, d):
    return tags.without_stop_keys(load(spark, d, "tags"), CODES.stop).select(F.col("kind").cast("int").alias("kind"), "id", "k", "v")


def tagged_objects(spark, d):
    """Nodes with an encoded tag, and ways with any tag."""
    t, n, w = _t(spark, d, "tags", "nodes", "ways")
    node = elements.nodes(n).select("id").join(tags.encode(t.filter("kind = 0"), CODES, "node"), "id", "left_semi").select(F.lit(0).alias("kind"), "id")
    way = elements.ways(w).select("id").join(t.filter("kind = 1"), "id", "left_semi").select(F.lit(1).alias("kind"), "id")
    return node.unionAll(way)


def tag_stats(spark, d):
    return tags.key_counts(load(spark, d, "tags"))


def tag_top_k(spark, d):
    """The 400 most frequent keys of each kind with more than 100 tags."""
    top = tags.key_ranks(tags.key_counts(load(spark, d, "tags")), 101).filter("rank < 400")
    return top.join(tag_stats(spark, d), ["kind", "k"]).select("kind", "k", "cnt", "rank")


def tag_key_rank(spark, d):
    return tags.key_ranks(tag_stats(spark, d))


def tag_totals(spark, d):
    """Tags and lengths of keys, in UTF-16 units, of each kind."""
    units = F.length("k") + F.length(F.regexp_replace("k", "[^\\x{10000}-\\x{10FFFF}]", ""))
    return load(spark, d, "tags").filter("k IS NOT NULL").groupBy(F.col("kind").cast("int").alias("kind")).agg(F.count(F.lit(1)).alias("n_tags"), F.sum(units).cast("bigint").alias("key_units"))


def tag_heavy_hitters(spark, d):
    return tag_stats(spark, d).groupBy("k").agg(F.sum("cnt").cast("bigint").alias("cnt")).filter("cnt >= 100")


def tag_cardinality(spark, d):
    return load(spark, d, "tags").agg(F.countDistinct("k").alias("n_keys"), F.countDistinct("v").alias("n_values"), F.count(F.lit(1)).alias("n_tags"))


def key_postings(spark, d):
    return tags.postings(load(spark, d, "tags"), ["k"], True, True)


def value_postings(spark, d):
    return tags.postings(load(spark, d, "tags"), ["v"], False, False)


def key_value_postings(spark, d):
    return tags.postings(load(spark, d, "tags"), ["k", "v"], False, False)


def ref_pack(spark, d):
    t = load(spark, d, "tags").select(geo.pack_ref(F.col("kind"), F.col("id")).alias("ref")).distinct()
    return t.select("ref", geo.unpack_kind(F.col("ref")).alias("kind"), geo.unpack_id(F.col("ref")).alias("id"))


def way_geometry(spark, d):
    return elements.way_geometry(*_t(spark, d, "ways", "nodes"))


def way_geometry_stats(spark, d):
    return elements.way_geometry_stats(way_geometry(spark, d))


def way_info(spark, d):
    return elements.way_info(*_t(spark, d, "ways", "nodes"))


def way_lookup(spark, d):
    """The ways that relations name."""
    named = elements.members(load(spark, d, "relations")).filter("type = 1").select(F.col("ref").alias("way_id"))
    return way_info(spark, d).join(named, "way_id", "left_semi")


def distinct_way_nodes(spark, d):
    return elements.way_refs(load(spark, d, "ways")).select("node_id").distinct()


def referenced_nodes(spark, d):
    n, w = _t(spark, d, "nodes", "ways")
    return elements.fixed_nodes(n).join(elements.way_refs(w).select(F.col("node_id").alias("id")), "id", "left_semi")


def dangling_refs(spark, d):
    n, w = _t(spark, d, "nodes", "ways")
    return elements.way_refs(w).join(elements.fixed_nodes(n).select(F.col("id").alias("node_id")), "node_id", "left_anti").select("way_id", "pos", "node_id")


def max_vertex_jump(spark, d):
    """The largest change of latitude between neighbours, and the least way that has it."""
    best = F.max(F.struct(F.col("diff").alias("max_diff"), (-F.col("way_id")).alias("w"))).alias("b")
    return elements.vertex_jumps(way_geometry(spark, d)).agg(best).select(F.col("b.max_diff").alias("max_diff"), (-F.col("b.w")).alias("way_id"))


def delta_encode(spark, d):
    w = Window.partitionBy("way_id").orderBy("pos")
    r = elements.way_refs(load(spark, d, "ways"))
    delta = F.col("node_id") - F.lag("node_id", 1, 0).over(w)
    return r.select("way_id", "pos", delta.alias("delta"), geo.zigzag(delta).alias("code"))


def delta_decode(spark, d):
    w = Window.partitionBy("way_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    e = delta_encode(spark, d)
    return e.select("way_id", "pos", F.sum(geo.unzigzag(F.col("code"))).over(w).cast("bigint").alias("node_id"))


def _way_lengths(spark, d):
    """References of each live way that has any."""
    n = F.size(F.filter("refs", lambda r: r.isNotNull())).cast("bigint").alias("n_nodes")
    return elements.ways(load(spark, d, "ways")).select(n).filter("n_nodes > 0")


def way_stats(spark, d):
    return _way_lengths(spark, d).agg(F.count(F.lit(1)).alias("n_ways"), F.max("n_nodes").alias("max_nodes"), F.avg("n_nodes").alias("mean_nodes"))


def way_len_hist(spark, d):
    return _way_lengths(spark, d).filter("n_nodes < 80").groupBy("n_nodes").agg(F.count(F.lit(1)).alias("cnt"))


def _box_sizes(spark, d):
    s = way_geometry_stats(spark, d)
    size = F.greatest(F.col("max_lat").cast("bigint") - F.col("min_lat"), F.col("max_lon").cast("bigint") - F.col("min_lon"))
    return s.select("way_id", size.alias("size"))


def way_size_quantiles(spark, d):
    """Box sizes, largest first, at about 50 evenly spaced ranks."""
    s = materialize(_box_sizes(spark, d))
    step = max(s.count() // QUANTILES, 1)
    return ranked(s, -F.shiftright("size", 16), [F.desc("size"), "way_id"]).filter((F.col("rank") % step == 0) | (F.col("rank") == 1)).select("rank", "size")


def sparse_index(spark, d):
    """Every 50th way in order of id."""
    w = elements.ways(load(spark, d, "ways")).select("id")
    return ranked(w, F.shiftright("id", 14), ["id"]).filter(F.col("rank") % SPARSE_STEP == SPARSE_STEP - 1).select("rank", F.col("id").alias("way_id"))


def _resolved(spark, d):
    return elements.relation_members(*_t(spark, d, "relations", "nodes", "ways"))


def relation_members(spark, d):
    return _resolved(spark, d).select("rel_id", "pos", "type", "ref", "role", "mid_lat", "mid_lon")


def relation_node_members(spark, d):
    return relation_members(spark, d).filter("type = 0")


def relation_way_members(spark, d):
    return relation_members(spark, d).filter("type = 1")


def relation_bbox(spark, d):
    return elements.relation_bbox(_resolved(spark, d))


def relation_size_stats(spark, d):
    n = F.greatest(F.size("members"), F.lit(0))
    return elements.relations(load(spark, d, "relations")).agg(F.max(n).alias("max_members"), F.sum(n).alias("total_members"), F.avg(n).alias("mean_members"))


def relation_size_hist(spark, d):
    r = elements.relations(load(spark, d, "relations")).select(F.greatest(F.size("members"), F.lit(0)).alias("n_members"))
    return r.filter("n_members < 1000").groupBy("n_members").agg(F.count(F.lit(1)).alias("cnt"))


def role_dictionary(spark, d):
    return elements.role_dictionary(load(spark, d, "relations"))


def blob_index(spark, d):
    return elements.block_stats(dict(enumerate(_t(spark, d, "nodes", "ways", "relations"))))


def phase_offsets(spark, d):
    """The first blocks that hold ways and relations."""
    b = blob_index(spark, d)
    return b.agg(F.min(F.when(F.col("ways_count") > 0, F.col("blob_no"))).alias("first_way_blob"), F.min(F.when(F.col("relations_count") > 0, F.col("blob_no"))).alias("first_relation_blob"))


def heat_map(spark, d):
    row, col = geo.heat_bin(F.col("lat"), F.col("lon"))
    return elements.fixed_nodes(load(spark, d, "nodes")).groupBy(row.alias("lat_bin"), col.alias("lon_bin")).agg(F.count(F.lit(1)).alias("cnt"))


def map_objects(spark, d):
    return elements.map_objects(*_t(spark, d, "nodes", "ways", "relations"))


def median_split(spark, d):
    """The latitude of rank n / 2 of all objects, and how many lie below it."""
    from terrane.operators.ranking import nth_value

    o = materialize(map_objects(spark, d).select(F.lit(1).alias("g"), "mid_lat"))
    m = nth_value(o, "g", "mid_lat", o.groupBy("g").agg(F.floor(F.count(F.lit(1)) / 2).alias("k")))
    return o.join(F.broadcast(m), "g").groupBy(F.col("value").alias("split_value")).agg(F.count(F.when(F.col("mid_lat") < F.col("value"), 1)).alias("below"), F.count(F.lit(1)).alias("items"))


def smallest_k(spark, d):
    """The 100 least codes: a heap's answer, as a top-k."""
    return morton_code(spark, d).orderBy(geo.unsigned_order(F.col("morton")), "id").limit(100)


def kd_tree_level(spark, d):
    """The first split of all objects."""
    return spatial.splits_of(materialize(map_objects(spark, d).withColumn("node_id", F.lit(1).cast("bigint"))), 0)


def kd_assign(spark, d):
    rows, _ = spatial.kd_tree(map_objects(spark, d), 0, KD_DEPTH)
    return rows.select("kind", "id", F.col("node_id").alias("leaf"))


def kd_leaf_stats(spark, d):
    return spatial.leaf_stats(spatial.kd_tree(map_objects(spark, d), 0, KD_DEPTH)[0])


def kd_levels(spark, d):
    """The leaves again, with all levels split by histograms and no subtree built by a task."""
    return spatial.leaf_stats(spatial.kd_tree(map_objects(spark, d), 0, KD_DEPTH, 0)[0])


def kd_partition(spark, d):
    """Leaves of at most 10 000."""
    return spatial.leaf_stats(spatial.kd_tree(map_objects(spark, d), KD_LIMIT)[0])


def varint_length(spark, d):
    e = delta_encode(spark, d)
    return e.select("way_id", "pos", geo.varint_length(F.col("code")).alias("n_bytes"))


def zigzag_codec(spark, d):
    """Changes of position between neighbouring vertices, coded and read back."""
    g = way_geometry(spark, d)
    w = Window.partitionBy("way_id").orderBy("pos")
    delta = F.col("lat").cast("bigint") - F.lag(F.col("lat").cast("bigint"), 1, 0).over(w)
    g = g.select("way_id", "pos", delta.alias("delta"))
    return g.select("way_id", "pos", "delta", geo.zigzag(F.col("delta")).alias("code"), geo.unzigzag(geo.zigzag(F.col("delta"))).alias("back"))


def stream_tag_counts(spark, d):
    """Tag counts by a stream over the table's files."""
    from terrane.streaming.tags import run_once, stream_table, tag_counts

    return run_once(tag_counts(stream_table(spark, f"{d}/tags.parquet")))


def _extract(spark, d, kind: int):
    """The live elements of one kind with their tags, written as an extract into the shared folder and read back by its source."""
    from terrane.sources.pbf import encode, register

    none = lambda *names: [F.lit(None).cast(dict(x.split(" ", 1) for x in encode.SCHEMA.split(", "))[n]).alias(n) for n in names]
    own = load(spark, d, ("nodes", "ways", "relations")[kind])
    if kind == encode.NODE:
        rows = elements.nodes(own).filter(geo.valid(F.col("lat"), F.col("lon"))).select("id", "lat", "lon", *none("refs", "members"))
    elif kind == encode.WAY:
        rows = elements.ways(own).select("id", *none("lat", "lon"), F.filter("refs", lambda r: r.isNotNull()).alias("refs"), *none("members"))
    else:
        held = F.filter("members", lambda m: m["type"].isNotNull() & m["ref"].isNotNull())
        member = F.transform(held, lambda m: F.struct(m["type"].cast("tinyint").alias("type"), m["ref"].alias("ref"), F.coalesce(m["role"], F.lit("")).alias("role")))
        rows = elements.relations(own).select("id", *none("lat", "lon", "refs"), member.alias("members"))
    found = load(spark, d, "tags").filter((F.col("kind") == kind) & F.col("k").isNotNull() & F.col("v").isNotNull()).groupBy("id").agg(F.collect_list(F.struct("k", "v")).alias("tags"))
    at = shared_table(spark)
    encode.write_extract(rows.join(found, "id", "left").withColumn("kind", F.lit(kind)), at)
    register(spark)
    return spark.read.format("osmpbf").option("entity", ("node", "way", "relation")[kind]).load(at)


def extract_nodes(spark, d):
    """Nodes through an extract, in its units of 1e-7 degrees."""
    unit = lambda c: F.floor(F.col(c) * 1e7 + 0.5).alias(f"{c}_e7")
    return _extract(spark, d, 0).select("id", unit("lat"), unit("lon"))


def extract_ways(spark, d):
    return _extract(spark, d, 1).select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))


def extract_relations(spark, d):
    m = _extract(spark, d, 2).select(F.col("id").alias("rel_id"), F.posexplode("members").alias("pos", "m"))
    return m.select("rel_id", "pos", F.col("m.type").cast("int").alias("type"), F.col("m.ref").alias("ref"), F.col("m.role").alias("role"))


def extract_tags(spark, d):
    """The tags of ways through an extract."""
    return _extract(spark, d, 1).select("id", F.inline("tags").alias("k", "v"))


QUERIES = {
    f.__name__: f
    for f in (
        node_scan, way_scan, relation_scan, tag_scan, coord_fixed, coord_degrees, morton_code, morton_sorted, bbox_contains, way_class,
        encode_node_tags, encode_way_tags, encode_common_tags, tag_stoplist, tagged_objects, tag_stats, tag_top_k, tag_key_rank, tag_totals,
        tag_heavy_hitters, tag_cardinality, key_postings, value_postings, key_value_postings, ref_pack, way_geometry, way_geometry_stats,
        way_info, way_lookup, distinct_way_nodes, referenced_nodes, dangling_refs, max_vertex_jump, delta_encode, delta_decode, way_stats,
        way_len_hist, way_size_quantiles, sparse_index, relation_members, relation_node_members, relation_way_members, relation_bbox,
        relation_size_stats, relation_size_hist, role_dictionary, blob_index, phase_offsets, heat_map, map_objects, median_split, smallest_k,
        kd_tree_level, kd_assign, kd_leaf_stats, kd_levels, kd_partition, varint_length, zigzag_codec, stream_tag_counts,
        encode_checked, key_ids, value_ids, extract_nodes, extract_ways, extract_relations, extract_tags,
    )
}

# --- the same in SQL ---------------------------------------------------------------------------------------------

_NOW = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST) AS rn FROM {t}) WHERE rn = 1 AND coalesce(visible, true)"
_VALID = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon)"
_N = f"WITH n AS MATERIALIZED (SELECT id, trunc(lat / 180.0::DOUBLE * 2147483647.0::DOUBLE)::INT AS lat, trunc(lon / 180.0::DOUBLE * 2147483647.0::DOUBLE)::INT AS lon FROM ({_NOW.format(t='nodes')}) WHERE {_VALID}) "
_W = f"w AS MATERIALIZED ({_NOW.format(t='ways')}), wr AS MATERIALIZED (SELECT way_id, pos, node_id FROM (SELECT id AS way_id, unnest(refs) AS node_id, generate_subscripts(refs, 1) - 1 AS pos FROM w) WHERE node_id IS NOT NULL) "
_G = ", g AS MATERIALIZED (SELECT way_id, pos, node_id, lat, lon FROM wr JOIN n ON n.id = wr.node_id) "
_S = ", s AS MATERIALIZED (SELECT way_id, count(*) AS n_nodes, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, trunc(sum(lat::BIGINT)::DOUBLE / count(*))::INT AS mid_lat, trunc(sum(lon::BIGINT)::DOUBLE / count(*))::INT AS mid_lon FROM g GROUP BY way_id) "
_R = f"r AS MATERIALIZED ({_NOW.format(t='relations')}), rm AS MATERIALIZED (SELECT rel_id, pos, m.type::INT AS type, m.ref AS ref, m.role AS role FROM (SELECT id AS rel_id, unnest(members) AS m, generate_subscripts(members, 1) - 1 AS pos FROM r)) "
_M = ", rr AS MATERIALIZED (SELECT rm.*, coalesce(n.lat, s.mid_lat) AS mid_lat, coalesce(n.lon, s.mid_lon) AS mid_lon, coalesce(n.lat, s.min_lat) AS min_lat, coalesce(n.lat, s.max_lat) AS max_lat, coalesce(n.lon, s.min_lon) AS min_lon, coalesce(n.lon, s.max_lon) AS max_lon FROM rm LEFT JOIN n ON rm.type = 0 AND n.id = rm.ref LEFT JOIN s ON rm.type = 1 AND s.way_id = rm.ref) "
_B = ", b AS MATERIALIZED (SELECT rel_id, count(*) AS n_members, count(mid_lat) AS n_resolved, min(min_lat) AS min_lat, max(max_lat) AS max_lat, min(min_lon) AS min_lon, max(max_lon) AS max_lon FROM rr GROUP BY rel_id) "
_O = ", o AS MATERIALIZED (SELECT 0 AS kind, id, lat AS mid_lat, lon AS mid_lon, 1::BIGINT AS weight FROM n UNION ALL SELECT 1, way_id, mid_lat, mid_lon, n_nodes + 1 FROM s UNION ALL SELECT 2, rel_id, floor((min_lat::BIGINT + max_lat) / 2)::INT, floor((min_lon::BIGINT + max_lon) / 2)::INT, 1 FROM b WHERE n_resolved > 0) "
_GEO = _N + ", " + _W + _G + _S
_ALL = _GEO + ", " + _R + _M + _B + _O


def _morton_sql() -> str:
    """By single bits instead of masks."""
    bit = "((({c}::BIGINT + 4294967296) % 4294967296) >> i) & 1"
    u = f"list_sum([({bit.format(c='lon')})::HUGEINT * (1::HUGEINT << (2 * i)) + ({bit.format(c='lat')})::HUGEINT * (1::HUGEINT << (2 * i + 1)) for i in range(32)])::HUGEINT"
    return f"SELECT id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS morton FROM (SELECT id, {u} AS u FROM n)"


def _codes_sql(scope: dict) -> str:
    return "CASE " + " ".join(f"WHEN k = '{k}' AND v = '{v}' THEN {c}" for (k, v), c in scope.items()) + " END"


def _encode_sql(own: dict, where: str) -> str:
    tag_id = f"coalesce({_codes_sql(own)}, {_codes_sql(CODES.common)})" if own else _codes_sql(CODES.common)
    key_id = "CASE k " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in CODES.keys.items()) + " END"
    stop = ", ".join(f"'{k}'" for k in CODES.stop)
    return f"SELECT kind::INT AS kind, id, tag_id, CASE WHEN tag_id IS NULL THEN key_id END AS key_id, CASE WHEN tag_id IS NULL THEN v END AS value FROM (SELECT *, {tag_id} AS tag_id, {key_id} AS key_id FROM tags WHERE {where} AND k IS NOT NULL AND k NOT IN ({stop})) WHERE tag_id IS NOT NULL OR key_id IS NOT NULL"


def _postings_sql(by: str, distinct: bool, desc: bool) -> str:
    d, o = "DISTINCT " if distinct else "", " DESC" if desc else ""
    have = " AND ".join(f"{c} IS NOT NULL" for c in by.split(", "))
    return f"SELECT {by}, block, string_agg(ref::VARCHAR, ',' ORDER BY ref{o}) AS refs FROM (SELECT {d}{by}, id * 4 + kind AS ref, (id * 4 + kind) // {1 << tags.BLOCK_BITS} AS block FROM tags WHERE {have}) GROUP BY {by}, block"


_HIGHWAY = "CASE highway " + " ".join(f"WHEN '{v}' THEN {c}" for v, c in tags.WAY_CLASSES.items()) + " END"


def _kd_sql(select: str, depth: int = KD_DEPTH, limit: int = 0) -> str:
    """Levels of the tree by row numbers; ``select`` reads the last one as ``last``."""
    parts = [_ALL, ", a0 AS (SELECT *, 1::BIGINT AS node FROM o)"]
    for i in range(depth):
        parts.append(f""", e{i} AS (SELECT * FROM (SELECT node, count(*) AS m, sum(weight) AS w, max(mid_lat)::BIGINT - min(mid_lat) AS tall, max(mid_lon)::BIGINT - min(mid_lon) AS wide FROM a{i} GROUP BY node) WHERE m > 1 AND w > {limit} AND (tall > 0 OR wide > 0)),
c{i} AS (SELECT a.*, e.m, e.tall >= e.wide AS by_lat, CASE WHEN e.tall >= e.wide THEN mid_lat ELSE mid_lon END AS c FROM a{i} a JOIN e{i} e USING (node)),
d{i} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY c, kind, id) - 1 AS rn, min(c) OVER (PARTITION BY node) AS least FROM c{i}),
v{i} AS MATERIALIZED (SELECT node, by_lat, coalesce(max(CASE WHEN rn = m // 2 AND c > least THEN c END), min(CASE WHEN c > least THEN c END)) AS split_value FROM d{i} GROUP BY node, by_lat),
a{i + 1} AS MATERIALIZED (SELECT a.kind, a.id, a.mid_lat, a.mid_lon, a.weight, CASE WHEN v.node IS NULL THEN a.node ELSE 2 * a.node + (CASE WHEN v.by_lat THEN a.mid_lat ELSE a.mid_lon END >= v.split_value)::BIGINT END AS node FROM a{i} a LEFT JOIN v{i} v ON v.node = a.node)""")
    return "".join(parts) + f", last AS (SELECT * FROM a{depth}) " + select


_LEAVES = "SELECT node AS leaf, count(*) AS items, sum(weight)::BIGINT AS weight, min(mid_lat) AS min_lat, max(mid_lat) AS max_lat, min(mid_lon) AS min_lon, max(mid_lon) AS max_lon FROM last GROUP BY node"


_LEN = "l AS (SELECT way_id, count(*) AS n_nodes FROM wr GROUP BY way_id) "
_DELTA = "e AS (SELECT way_id, pos, node_id, node_id - lag(node_id, 1, 0) OVER (PARTITION BY way_id ORDER BY pos) AS delta FROM wr) "
_ZZ = "CASE WHEN {c} < 0 THEN -2 * {c} - 1 ELSE 2 * {c} END"
_KC = "c AS (SELECT kind::INT AS kind, k, count(*) AS cnt FROM tags WHERE k IS NOT NULL GROUP BY kind, k) "
_RANK = "row_number() OVER (PARTITION BY kind ORDER BY cnt DESC, k) - 1 AS rank"
_BLOB = "b AS (SELECT kind * 1099511627776 + floor(id / 8000)::BIGINT AS blob_no, count(CASE WHEN kind = 0 THEN 1 END) AS nodes_count, min(CASE WHEN kind = 0 THEN id END) AS min_node_id, max(CASE WHEN kind = 0 THEN id END) AS max_node_id, count(CASE WHEN kind = 1 THEN 1 END) AS ways_count, count(CASE WHEN kind = 2 THEN 1 END) AS relations_count FROM (SELECT 0::BIGINT AS kind, id FROM nodes UNION ALL SELECT 1, id FROM ways UNION ALL SELECT 2, id FROM relations) WHERE id IS NOT NULL GROUP BY 1) "
_MEMBERS = _GEO + ", " + _R + _M + "SELECT rel_id, pos, type, ref, role, mid_lat, mid_lon FROM rr"

SQL = {
    "extract_nodes": f"SELECT id, floor(lat * 1e7::DOUBLE + 0.5::DOUBLE)::BIGINT AS lat_e7, floor(lon * 1e7::DOUBLE + 0.5::DOUBLE)::BIGINT AS lon_e7 FROM ({_NOW.format(t='nodes')}) WHERE {_VALID}",
    "extract_ways": f"SELECT way_id, pos, node_id FROM (SELECT id AS way_id, unnest(r) AS node_id, generate_subscripts(r, 1) - 1 AS pos FROM (SELECT id, list_filter(refs, lambda x: x IS NOT NULL) AS r FROM ({_NOW.format(t='ways')})))",
    "extract_relations": f"SELECT rel_id, pos, m.type::INT AS type, m.ref AS ref, coalesce(m.role, '') AS role FROM (SELECT id AS rel_id, unnest(r) AS m, generate_subscripts(r, 1) - 1 AS pos FROM (SELECT id, list_filter(members, lambda x: x.type IS NOT NULL AND x.ref IS NOT NULL) AS r FROM ({_NOW.format(t='relations')})))",
    "extract_tags": f"SELECT t.id, k, v FROM tags t JOIN ({_NOW.format(t='ways')}) w ON w.id = t.id WHERE t.kind = 1 AND k IS NOT NULL AND v IS NOT NULL",
    "node_scan": f"SELECT id, CASE WHEN NOT isnan(lat) THEN lat END AS lat, CASE WHEN NOT isnan(lon) THEN lon END AS lon FROM ({_NOW.format(t='nodes')})",
    "way_scan": "WITH " + _W + "SELECT * FROM wr",
    "relation_scan": "WITH " + _R + "SELECT * FROM rm",
    "tag_scan": "SELECT kind::INT AS kind, id, k, v FROM tags",
    "coord_fixed": _N + "SELECT * FROM n",
    "coord_degrees": _N + "SELECT id, lat * 180.0::DOUBLE / 2147483647.0::DOUBLE AS lat, lon * 180.0::DOUBLE / 2147483647.0::DOUBLE AS lon FROM n",
    "morton_code": _N + _morton_sql(),
    "morton_sorted": _N + f"SELECT morton FROM ({_morton_sql()})",
    "bbox_contains": _GEO + "SELECT way_id, count(CASE WHEN lat > min_lat AND lat <= max_lat AND lon > min_lon AND lon <= max_lon THEN 1 END) AS n_inside FROM g JOIN s USING (way_id) GROUP BY way_id",
    "way_class": f"WITH {_W}, t AS (SELECT id, min(CASE WHEN lower(k) = 'highway' THEN lower(coalesce(v, '')) END) AS highway, max(CASE WHEN lower(k) = 'building' THEN 1 END) AS building FROM tags WHERE kind = 1 GROUP BY id) SELECT w.id AS way_id, CASE WHEN highway IS NOT NULL THEN coalesce({_HIGHWAY}, 2) WHEN building = 1 THEN 100 ELSE 1 END AS way_type FROM w LEFT JOIN t ON t.id = w.id",
    "encode_node_tags": _encode_sql(CODES.node, "kind = 0"),
    "encode_checked": _encode_sql(CODES.node, "kind = 0"),
    "key_ids": "SELECT k, row_number() OVER (ORDER BY k) - 1 AS key_id FROM (SELECT DISTINCT k FROM tags WHERE k IS NOT NULL)",
    "value_ids": "SELECT v, row_number() OVER (ORDER BY v) - 1 AS value_id FROM (SELECT DISTINCT v FROM tags WHERE v IS NOT NULL)",
    "encode_way_tags": _encode_sql(CODES.way, "kind = 1"),
    "encode_common_tags": _encode_sql({}, "true"),
    "tag_stoplist": "SELECT kind::INT AS kind, id, k, v FROM tags WHERE k NOT IN ('name', 'source')",
    "tagged_objects": f"SELECT 0 AS kind, id FROM ({_NOW.format(t='nodes')}) WHERE id IN (SELECT id FROM ({_encode_sql(CODES.node, 'kind = 0')})) UNION ALL SELECT 1, id FROM ({_NOW.format(t='ways')}) WHERE id IN (SELECT id FROM tags WHERE kind = 1)",
    "tag_stats": f"WITH {_KC} SELECT * FROM c",
    "tag_top_k": f"WITH {_KC} SELECT kind, k, cnt, rank FROM (SELECT *, {_RANK} FROM c WHERE cnt > 100) WHERE rank < 400",
    "tag_key_rank": f"WITH {_KC} SELECT kind, k, {_RANK} FROM c WHERE cnt >= 10",
    "tag_totals": "SELECT kind::INT AS kind, count(*) AS n_tags, sum(length(k) + length(regexp_replace(k, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS key_units FROM tags WHERE k IS NOT NULL GROUP BY kind",
    "tag_heavy_hitters": "SELECT k, count(*) AS cnt FROM tags WHERE k IS NOT NULL GROUP BY k HAVING count(*) >= 100",
    "tag_cardinality": "SELECT count(DISTINCT k) AS n_keys, count(DISTINCT v) AS n_values, count(*) AS n_tags FROM tags",
    "key_postings": _postings_sql("k", True, True),
    "value_postings": _postings_sql("v", False, False),
    "key_value_postings": _postings_sql("k, v", False, False),
    "ref_pack": "SELECT DISTINCT id * 4 + kind AS ref, kind::INT AS kind, id FROM tags",
    "way_geometry": _N + ", " + _W + _G + "SELECT * FROM g",
    "way_geometry_stats": _GEO + "SELECT * FROM s",
    "way_info": _GEO + "SELECT w.id AS way_id, coalesce(n_nodes, 0) AS n_nodes, s.* EXCLUDE (way_id, n_nodes) FROM w LEFT JOIN s ON s.way_id = w.id",
    "way_lookup": _GEO + ", " + _R + "SELECT w.id AS way_id, coalesce(n_nodes, 0) AS n_nodes, s.* EXCLUDE (way_id, n_nodes) FROM w LEFT JOIN s ON s.way_id = w.id WHERE w.id IN (SELECT ref FROM rm WHERE type = 1)",
    "distinct_way_nodes": "WITH " + _W + "SELECT DISTINCT node_id FROM wr",
    "referenced_nodes": _N + ", " + _W + "SELECT * FROM n WHERE id IN (SELECT node_id FROM wr)",
    "dangling_refs": _N + ", " + _W + "SELECT * FROM wr WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = wr.node_id)",
    "max_vertex_jump": _N + ", " + _W + _G + ", j AS (SELECT way_id, abs(lat::BIGINT - lag(lat::BIGINT) OVER (PARTITION BY way_id ORDER BY pos)) AS diff FROM g) SELECT diff AS max_diff, min(way_id) AS way_id FROM j WHERE diff = (SELECT max(diff) FROM j) GROUP BY diff",
    "delta_encode": f"WITH {_W}, {_DELTA} SELECT way_id, pos, delta, {_ZZ.format(c='delta')} AS code FROM e",
    "delta_decode": "WITH " + _W + "SELECT * FROM wr",
    "way_stats": f"WITH {_W}, {_LEN} SELECT count(*) AS n_ways, max(n_nodes) AS max_nodes, avg(n_nodes) AS mean_nodes FROM l",
    "way_len_hist": f"WITH {_W}, {_LEN} SELECT n_nodes, count(*) AS cnt FROM l WHERE n_nodes < 80 GROUP BY n_nodes",
    "way_size_quantiles": _GEO + ", z AS (SELECT greatest(max_lat::BIGINT - min_lat, max_lon::BIGINT - min_lon) AS size, way_id FROM s), y AS (SELECT size, row_number() OVER (ORDER BY size DESC, way_id) - 1 AS rank, count(*) OVER () AS m FROM z) SELECT rank, size FROM y WHERE rank % greatest(m // 50, 1) = 0 OR rank = 1",
    "sparse_index": f"WITH {_W} SELECT rank, id AS way_id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM w) WHERE rank % 50 = 49",
    "relation_members": _MEMBERS,
    "relation_node_members": _MEMBERS + " WHERE type = 0",
    "relation_way_members": _MEMBERS + " WHERE type = 1",
    "relation_bbox": _GEO + ", " + _R + _M + _B + "SELECT * FROM b",
    "relation_size_stats": f"WITH {_R} SELECT max(coalesce(len(members), 0))::INT AS max_members, sum(coalesce(len(members), 0))::BIGINT AS total_members, avg(coalesce(len(members), 0)) AS mean_members FROM r",
    "relation_size_hist": f"WITH {_R} SELECT coalesce(len(members), 0)::INT AS n_members, count(*) AS cnt FROM r WHERE coalesce(len(members), 0) < 1000 GROUP BY 1",
    "role_dictionary": f"WITH {_R}, f AS (SELECT role, rel_id, pos, row_number() OVER (PARTITION BY role ORDER BY rel_id, pos) AS q FROM rm WHERE role IS NOT NULL) SELECT role, row_number() OVER (ORDER BY rel_id, pos) - 1 AS role_id FROM f WHERE q = 1",
    "blob_index": f"WITH {_BLOB} SELECT * FROM b",
    "phase_offsets": f"WITH {_BLOB} SELECT min(CASE WHEN ways_count > 0 THEN blob_no END) AS first_way_blob, min(CASE WHEN relations_count > 0 THEN blob_no END) AS first_relation_blob FROM b",
    "heat_map": _N + "SELECT (lat::BIGINT + 2147483647) // 262144 AS lat_bin, (lon::BIGINT + 2147483647) // 131072 AS lon_bin, count(*) AS cnt FROM n GROUP BY 1, 2",
    "map_objects": _ALL + "SELECT * FROM o",
    "median_split": _ALL + ", q AS (SELECT mid_lat, row_number() OVER (ORDER BY mid_lat) - 1 AS rn, count(*) OVER () AS m FROM o), v AS (SELECT mid_lat AS split_value FROM q WHERE rn = m // 2) SELECT split_value, (SELECT count(*) FROM o WHERE o.mid_lat < split_value) AS below, (SELECT count(*) FROM o) AS items FROM v",
    "smallest_k": _N + f"SELECT id, morton FROM ({_morton_sql()}) ORDER BY morton < 0, morton, id LIMIT 100",
    "kd_tree_level": _kd_sql("SELECT node AS node_id, by_lat, split_value FROM v0"),
    "kd_assign": _kd_sql("SELECT kind, id, node AS leaf FROM last"),
    "kd_leaf_stats": _kd_sql(_LEAVES),
    "kd_levels": _kd_sql(_LEAVES),
    "kd_partition": _kd_sql(_LEAVES, 10, KD_LIMIT),
    "stream_tag_counts": f"WITH {_KC} SELECT * FROM c",
    "varint_length": f"WITH {_W}, {_DELTA}, z AS (SELECT way_id, pos, {_ZZ.format(c='delta')} AS code FROM e) SELECT way_id, pos, CASE WHEN code = 0 THEN 1 ELSE floor(log2(code::DOUBLE) / 7)::INT + 1 END AS n_bytes FROM z",
    "zigzag_codec": _N + ", " + _W + _G + f", j AS (SELECT way_id, pos, lat::BIGINT - lag(lat::BIGINT, 1, 0) OVER (PARTITION BY way_id ORDER BY pos) AS delta FROM g) SELECT way_id, pos, delta, {_ZZ.format(c='delta')} AS code, delta AS back FROM j",
}
