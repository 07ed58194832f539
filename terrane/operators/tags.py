"""Tag statistics, dictionaries, encodings and inverted indexes over the flat table (kind, id, k, v)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators.ranking import ranked

#: Ids of one posting block: 2 ** BLOCK_BITS packed references.
BLOCK_BITS = 18
#: Codes of one dictionary that are tested one by one; a longer one is a table, joined by its measured size.
LITERALS = 64


@dataclass(frozen=True)
class Codes:
    """Dictionaries of the tag encoding: up to ``LITERALS`` codes are written into the plan, more are joined as a table."""

    node: dict[tuple[str, str], int] = field(default_factory=dict)
    way: dict[tuple[str, str], int] = field(default_factory=dict)
    common: dict[tuple[str, str], int] = field(default_factory=dict)
    keys: dict[str, int] = field(default_factory=dict)
    stop: tuple[str, ...] = ()

    @classmethod
    def read(cls, path: str) -> Codes:
        """From a JSON settings file: KeyCodes, NodeTagCodes, WayTagCodes, TagCodes, KeyStopList."""
        import json

        with open(path, encoding="utf-8") as f:
            s = json.load(f)
        pairs = lambda name: {(x["Key"], x["Value"]): x["TagId"] for x in s.get(name, [])}
        return cls(pairs("NodeTagCodes"), pairs("WayTagCodes"), pairs("TagCodes"), s.get("KeyCodes", {}), tuple(s.get("KeyStopList", [])))


def _with_code(rows: DataFrame, codes: dict[tuple, int], by: list[str], name: str, literals: int) -> DataFrame:
    """``rows`` with the code ``name`` of the columns ``by``, or null."""
    if len(codes) > literals:
        kinds = ", ".join(f"{c} string" for c in by)
        table = rows.sparkSession.createDataFrame([(*key, code) for key, code in codes.items()], f"{kinds}, {name} int")
        return rows.join(table, by, "left")
    out = F.lit(None).cast("int")
    for key, code in reversed(codes.items()):
        hit = F.lit(True)
        for c, x in zip(by, key):
            hit = hit & (F.col(c) == x)
        out = F.when(hit, code).otherwise(out)
    return rows.withColumn(name, out)


def without_stop_keys(tags: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    return tags.filter(F.col("k").isNotNull() & ~F.col("k").isin(*stop)) if stop else tags.filter(F.col("k").isNotNull())


def encode(tags: DataFrame, codes: Codes, scope: str = "common", literals: int = LITERALS) -> DataFrame:
    """(kind, id, tag_id, key_id, value): a code of the whole tag, else of its key with the value kept, else no row."""
    rows = without_stop_keys(tags, codes.stop).select(F.col("kind").cast("int").alias("kind"), "id", "k", "v")
    rows = _with_code(rows, {"node": codes.node, "way": codes.way, "common": {}}[scope], ["k", "v"], "own_code", literals)
    rows = _with_code(rows, codes.common, ["k", "v"], "common_code", literals)
    rows = _with_code(rows, {(k,): code for k, code in codes.keys.items()}, ["k"], "key_code", literals)
    rows = rows.withColumn("tag_id", F.coalesce("own_code", "common_code"))
    rows = rows.withColumn("key_id", F.when(F.col("tag_id").isNull(), F.col("key_code"))).filter(F.col("tag_id").isNotNull() | F.col("key_id").isNotNull())
    return rows.select("kind", "id", "tag_id", "key_id", F.when(F.col("key_id").isNotNull(), F.col("v")).alias("value"))


def surrogate_ids(tags: DataFrame, column: str, name: str) -> DataFrame:
    """(``column``, ``name``): a number from 0 for each distinct value, in order of the values; nulls have none."""
    values = tags.filter(F.col(column).isNotNull()).select(column).distinct()
    return ranked(values, F.substring(column, 1, 4), [column], name=name).select(column, name)


def checked(encoded: DataFrame) -> DataFrame:
    """Raises where a row isn't exactly one of the two shapes."""
    ok = F.col("tag_id").isNotNull() != F.col("key_id").isNotNull()
    return encoded.withColumn("tag_id", F.when(ok, F.col("tag_id")).otherwise(F.raise_error(F.lit("not one shape of an encoded tag")).cast("int")))


#: Classes of ways by their highway tag.
WAY_CLASSES = {"motorway": 3, "motorway_link": 3, "trunk": 4, "trunk_link": 4, "primary": 5, "primary_link": 5, "secondary": 6, "secondary_link": 6, "tertiary": 7, "tertiary_link": 7, "unclassified": 8, "residential": 9, "living_street": 10, "service": 11, "pedestrian": 12, "track": 13, "bus_guideway": 14, "escape": 15, "raceway": 16, "road": 17, "footway": 18, "steps": 19, "path": 20, "cycleway": 21, "bridleway": 22}
OTHER_HIGHWAY, BUILDING, NO_CLASS = 2, 100, 1


def way_class(way_ids: DataFrame, tags: DataFrame) -> DataFrame:
    """(way_id, way_type) of each way of ``way_ids`` (id): by its highway tag, else any building, else 1.

    Of several highway tags the least value in lower case counts, as the table has no order.
    """
    key = F.lower("k")
    found = tags.filter("kind = 1").groupBy("id").agg(F.min(F.when(key == "highway", F.lower(F.coalesce("v", F.lit(""))))).alias("highway"), F.max(F.when(key == "building", True)).alias("building"))
    code = None
    for v, c in WAY_CLASSES.items():
        code = F.when(F.col("highway") == v, c) if code is None else code.when(F.col("highway") == v, c)
    code = code.when(F.col("highway").isNotNull(), OTHER_HIGHWAY).when(F.col("building"), BUILDING).otherwise(NO_CLASS)
    return way_ids.join(found, "id", "left").select(F.col("id").alias("way_id"), code.alias("way_type"))


def key_counts(tags: DataFrame) -> DataFrame:
    """(kind, k, cnt)."""
    return tags.filter(F.col("k").isNotNull()).groupBy(F.col("kind").cast("int").alias("kind"), "k").agg(F.count(F.lit(1)).alias("cnt"))


def key_ranks(counts: DataFrame, least: int = 10) -> DataFrame:
    """(kind, k, rank): 0-based, most frequent first, ties by key; keys below ``least`` are left out."""
    rows = counts.filter(F.col("cnt") >= least)
    return ranked(rows, -F.col("cnt"), ["k"], ["kind"]).select("kind", "k", "rank")


def postings(tags: DataFrame, by: list[str], distinct: bool, descending: bool) -> DataFrame:
    """(``by``, block, refs): inverted index of packed references, comma-joined, in blocks of 2 ** ``BLOCK_BITS`` ids.

    A key that a third of all rows have is spread over its blocks; within one, references are collected and sorted.
    """
    rows = tags
    for c in by:
        rows = rows.filter(F.col(c).isNotNull())
    rows = rows.select(*by, geo.pack_ref(F.col("kind"), F.col("id")).alias("ref")).withColumn("block", F.shiftright("ref", BLOCK_BITS))
    collect = F.collect_set if distinct else F.collect_list
    refs = F.sort_array(collect("ref"), asc=not descending)
    return rows.groupBy(*by, "block").agg(F.concat_ws(",", F.transform(refs, lambda r: r.cast("string"))).alias("refs"))
