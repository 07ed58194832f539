"""Spatial partitioning: a kd-tree over (kind, id, mid_lat, mid_lon, weight).

Tree nodes of more than ``FINISH`` objects are split level by level: a few aggregations over all rows, and joins with
tables of one row a tree node, which are written first, so that their true sizes decide how they are joined. Medians are
exact, by histograms, so no task sorts or holds such a node's rows. The subtrees below are built by one task each, of
at most ``FINISH`` objects, with the same exact medians; nodes of any size that can't be split stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.ranking import piece as _piece
from terrane.session import materialize, release

MAX_DEPTH = 40
#: Levels after which the rows are written anew; between, they are routed by joins with the levels' splits.
REWRITE = 4
#: Objects of a tree node whose subtree one task builds.
FINISH = 1 << 17


def _extents(rows: DataFrame) -> DataFrame:
    ends = [f(c).cast("bigint").alias(f"{f.__name__}_{c}") for c in ("mid_lat", "mid_lon") for f in (F.min, F.max)]
    return rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("items"), F.sum("weight").alias("weight"), *ends)


def splits_of(rows: DataFrame, limit: int, extents: DataFrame | None = None) -> DataFrame:
    """(node_id, by_lat, split_value) for the tree nodes of ``rows`` (of ``extents``) that weigh more than ``limit`` and can be split.

    The axis is the longer one (latitude if equal), the value that of the middle row (rank n / 2); where that is the
    least value the next greater one is taken, and where there is none the other axis; nodes at one place stay whole.
    """
    e = (materialize(_extents(rows)) if extents is None else extents).filter((F.col("weight") > limit) & (F.col("items") > 1))
    lat, lon = F.col("max_mid_lat") - F.col("min_mid_lat"), F.col("max_mid_lon") - F.col("min_mid_lon")
    e = e.filter((lat > 0) | (lon > 0)).select("node_id", "items", (lat >= lon).alias("by_lat"), F.when(lat >= lon, F.col("min_mid_lat")).otherwise(F.col("min_mid_lon")).alias("least"))
    own = rows.join(e, "node_id").select("node_id", "by_lat", "items", "least", F.when(F.col("by_lat"), F.col("mid_lat")).otherwise(F.col("mid_lon")).alias("c"))
    # the middle by the upper 16 bits of the axis, with the least value above the least; then by the lower 16 in its piece
    v = F.col("c").cast("bigint") + 2**31
    own = own.withColumn("hi", F.shiftright(v, 16)).withColumn("lo", v.bitwiseAND(F.lit(0xFFFF)))
    node = Window.partitionBy("node_id")
    high = own.groupBy("node_id", "by_lat", "least", (F.floor(F.col("items") / 2)).alias("k"), "hi").agg(F.count(F.lit(1)).alias("m"), F.min(F.when(F.col("c") > F.col("least"), F.col("c"))).alias("above"))
    high = high.withColumn("above", F.min("above").over(node))
    high = materialize(_piece(high, "hi").select("node_id", "by_lat", "least", "above", "hi", (F.col("k") - F.col("before")).alias("k")))
    low = own.select("node_id", "hi", "lo").join(high.select("node_id", "hi"), ["node_id", "hi"]).groupBy("node_id", "hi", "lo").agg(F.count(F.lit(1)).alias("m"))
    middle = _piece(low.join(high, ["node_id", "hi"]), "lo").withColumn("value", (F.shiftleft("hi", 16) + F.col("lo") - 2**31).cast("int"))
    return middle.select("node_id", "by_lat", F.when(F.col("value") > F.col("least"), F.col("value")).otherwise(F.col("above")).alias("split_value"))


def route(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Moves the rows of split nodes to their children: 2 n below the split value, else 2 n + 1."""
    c = F.when(F.col("by_lat"), F.col("mid_lat")).otherwise(F.col("mid_lon"))
    child = F.when(F.col("split_value").isNull(), F.col("node_id")).otherwise(F.col("node_id") * 2 + (c >= F.col("split_value")).cast("bigint"))
    return rows.join(splits, "node_id", "left").withColumn("node_id", child).drop("by_lat", "split_value")


def _subtrees(limit: int, depth: int, columns: list[str]):
    """The rows of one tree node under their leaves, and behind them the splits (``by_lat``, ``split_value``)."""

    def run(key, table):
        lat, lon, weight = (table[c].to_numpy() for c in ("mid_lat", "mid_lon", "weight"))
        leaf = np.zeros(table.num_rows, np.int64)
        splits: list[tuple[int, bool, int]] = []
        todo = [(key[0].as_py(), np.arange(table.num_rows))]
        while todo:
            node, own = todo.pop()
            leaf[own] = node
            if node.bit_length() > depth or len(own) < 2 or weight[own].sum() <= limit:
                continue
            y, x = lat[own].astype(np.int64), lon[own].astype(np.int64)
            tall, wide = y.max() - y.min(), x.max() - x.min()
            if tall == wide == 0:
                continue
            c = y if tall >= wide else x
            value = np.partition(c, len(c) // 2)[len(c) // 2]
            if value == c.min():
                value = c[c > value].min()
            splits.append((node, bool(tall >= wide), int(value)))
            todo += [(2 * node, own[c < value]), (2 * node + 1, own[c >= value])]
        n, m = table.num_rows, len(splits)
        table = table.set_column(table.schema.get_field_index("node_id"), "node_id", pa.array(leaf))
        none = {f.name: pa.nulls(m, f.type) for f in table.schema}
        own = pa.table([pa.concat_arrays([*table[c].chunks, none[c] if c != "node_id" else pa.array([x[0] for x in splits], pa.int64())]) for c in columns], names=columns)
        return own.append_column("by_lat", pa.array([None] * n + [x[1] for x in splits], pa.bool_())).append_column("split_value", pa.array([None] * n + [x[2] for x in splits], pa.int32()))

    return run


def kd_tree(objects: DataFrame, limit: int, depth: int = MAX_DEPTH, finish: int = FINISH) -> tuple[DataFrame, DataFrame]:
    """(assigned, splits): ``objects`` with their leaf's ``node_id``, and the tree (node_id, by_lat, split_value)."""
    depth = min(depth, 60)
    base = rows = materialize(objects.withColumn("node_id", F.lit(1).cast("bigint")))
    tree = objects.sparkSession.createDataFrame([], "node_id bigint, by_lat boolean, split_value int")
    for i in range(depth):
        extents = materialize(_extents(rows))
        found = materialize(splits_of(rows, limit, extents.filter(F.col("items") > finish)))
        release(extents)
        if found.isEmpty():
            release(found)
            break
        tree = tree.unionByName(found)
        rows = route(rows, found)
        if i % REWRITE == REWRITE - 1:
            moved = materialize(rows)
            release(base)
            base = rows = moved
    rows = rows.select(*objects.columns, "node_id")
    if not finish:
        return rows, tree
    small = materialize(_extents(rows).filter(F.col("items") <= finish).select("node_id"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    done = materialize(rows.join(small, "node_id", "left_semi").select(*rows.columns).groupBy("node_id").applyInArrow(_subtrees(limit, depth, rows.columns), f"{kinds}, by_lat boolean, split_value int"))
    large = rows.join(small, "node_id", "left_anti").select(*rows.columns)
    assigned = done.filter("by_lat IS NULL").select(*rows.columns).unionAll(large)
    return assigned, tree.unionByName(done.filter("by_lat IS NOT NULL").select("node_id", "by_lat", "split_value"))


def assign(objects: DataFrame, tree: DataFrame, depth: int) -> DataFrame:
    """Routes new objects through a tree of ``depth`` levels."""
    rows = objects.withColumn("node_id", F.lit(1).cast("bigint"))
    for _ in range(depth):
        rows = route(rows, tree)
    return rows


def leaf_stats(assigned: DataFrame) -> DataFrame:
    """(leaf, items, weight, bounds of the middles)."""
    ends = [f(f"mid_{c}").alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)]
    return assigned.groupBy(F.col("node_id").alias("leaf")).agg(F.count(F.lit(1)).alias("items"), F.sum("weight").alias("weight"), *ends)
