"""Mixing sources to target weights: which documents to use, and how often, so that each source has its share of the tokens.

Documents are counted by source and exact token length. Each source's budget is its share of the largest total that all
wanted sources can fill within their ``max_repeats`` (or of a given total). Most of a budget is filled by whole
passes over the source, and in proportion from all lengths; what remains is fitted by a bounded-knapsack dynamic programme over the lengths that have copies left. The
programme sees lengths and counts only. Documents of a length are then taken in a seeded order until its count is
reached, each at most ``max_repeats`` times, evenly: none is used twice before all of its length are used once.

Defined results: names are compared trimmed and in lower case; a null source is no source; sources without documents and
those of weight zero, null or negative get nothing, and their shares go to the others in proportion; null ``max_repeats``
counts as 1; texts without tokens are never chosen; of targets that name a source twice the weights add up and the
smaller ``max_repeats`` holds; ties are ordered by the seeded hash, then the id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens left for the dynamic programme at the end of a budget; its time and memory depend on nothing else. Where no
#: free length is short enough to come down to it, no two of them fit any more, and the longest that does is the optimum.
FIT = 1 << 14
SEED = 17
#: Lengths of more documents are ranked in parts, by so many bits of the seeded hash.
CROWD, PART_BITS = 1 << 14, 10


def source_name(c):
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def fit(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Copies of each length so that they sum to at most ``budget``, as near to it as any choice comes.

    Bounded subset sums over all of 0..budget: for each length the fewest copies that reach a sum, in numpy rows; a sum keeps
    the length that first reached it, by which the choice is read back.
    """
    order = np.argsort(-lengths, kind="stable")
    by = np.full(budget + 1, -1, np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    for at in order.tolist():
        size, most = int(lengths[at]), int(free[at])
        if size > budget or most <= 0:
            continue
        if reached[budget]:
            break
        # sums in columns of one remainder: from each reached sum upwards, at most ``most`` steps of this length
        rows = -(-(budget + 1) // size)
        grid = np.zeros(rows * size, bool)
        grid[: budget + 1] = reached
        grid = grid.reshape(rows, size)
        step = np.arange(rows)[:, None]
        last = np.maximum.accumulate(np.where(grid, step, -1), axis=0)
        new = (~grid & (last >= 0) & (step - last <= most)).reshape(-1)[: budget + 1]
        by[new] = at
        reached |= new
    out = np.zeros(len(lengths), np.int64)
    s = int(np.nonzero(reached)[0].max())
    while s > 0:
        at = int(by[s])
        out[at] += 1
        s -= int(lengths[at])
    return out


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """The number of copies to take of each length of one source."""
    pdf = pdf.sort_values("n_tokens").reset_index(drop=True)
    size, docs = pdf["n_tokens"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64)
    budget, once, most = int(pdf["budget"].iloc[0]), int((size * docs).sum()), int(pdf["max_repeats"].iloc[0])
    # whole passes over the source first: none is used again before all were used as often
    passes = min(budget // once, most)
    take, left = docs * passes, budget - passes * once
    if passes < most:
        room = docs * (passes + 1)
        # an even share of every length: whole copies of the running sum
        more = np.diff(np.floor(np.cumsum(docs * (max(left - FIT // 2, 0) / once)) + 1e-9).astype(np.int64), prepend=0)
        take, left = take + more, left - int((size * more).sum())
        for at in range(len(size) - 1, -1, -1):  # a running sum may be ahead by one long document
            if left >= 0:
                break
            if more[at]:
                take[at] -= 1
                left += int(size[at])
        while left > FIT:
            free = np.nonzero((take < room) & (size <= left - FIT // 2))[0]
            if not len(free):
                break
            at = free[-1]
            n = min(int(room[at] - take[at]), max(1, (left - FIT // 2) // int(size[at])))
            take[at] += n
            left -= n * int(size[at])
        if left > FIT:  # free lengths are over left - FIT / 2, so that no two fit: the longest that does
            take[np.nonzero((take < room) & (size <= left))[0][-1:]] += 1
        else:
            take += fit(size, room - take, left)
    return pd.DataFrame({"source": pdf["source"], "n_tokens": size, "copies": take})


def targets_of(targets: DataFrame) -> DataFrame:
    t = targets.select(source_name(F.col("source")).alias("source"), F.coalesce(F.greatest("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    return t.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))


def plan(counted: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, n_tokens, docs, copies) for each token length of each wanted source; ``counted`` has source, n_tokens."""
    lengths = counted.filter("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    rows = lengths.join(targets_of(targets).filter("weight > 0 AND max_repeats > 0"), "source")
    # one row a source of the targets: the budgets
    most = rows.groupBy("source", "weight").agg(F.sum(F.col("n_tokens") * F.col("docs") * F.col("max_repeats")).cast("double").alias("most"))
    every = Window.partitionBy(F.lit(1))
    share = F.col("weight") / F.sum("weight").over(every)
    whole = F.lit(float(total)) if total is not None else F.min(F.col("most") / F.col("share")).over(every)
    budgets = most.withColumn("share", share).withColumn("budget", F.floor(F.least(whole * F.col("share") + 1e-6, "most")).cast("bigint")).select("source", "budget")
    chosen = rows.join(budgets, "source").select("source", "n_tokens", "docs", "max_repeats", "budget").groupBy("source").applyInPandas(_choose, "source string, n_tokens bigint, copies bigint")
    return lengths.join(chosen, ["source", "n_tokens"])


def select(counted: DataFrame, plan: DataFrame, id_col: str = "doc_id", seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """(``id_col``, source, n_tokens, repeats) of the documents to use.

    A length of more than ``crowd`` documents is ranked in parts of the seeded hash, whose counts are added up, so that a
    length that a third of all documents have isn't sorted in one task.
    """
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    part = F.when(F.col("docs") > crowd, F.shiftright("h", 64 - PART_BITS)).otherwise(0).cast("bigint")
    rows = counted.filter("n_tokens > 0").select(id_col, "source", "n_tokens", h.alias("h")).join(plan, ["source", "n_tokens"]).withColumn("part", part)
    parts = rows.filter(F.col("docs") > crowd).groupBy("source", "n_tokens", "part").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("source", "n_tokens", "part", before.alias("before"))
    rank = F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("source", "n_tokens", "part").orderBy("h", id_col)) - 1
    each = F.floor(F.col("copies") / F.col("docs")) + (F.col("rank") < F.col("copies") % F.col("docs")).cast("bigint")
    out = rows.join(parts, ["source", "n_tokens", "part"], "left").withColumn("rank", rank).withColumn("repeats", each.cast("int"))
    return out.filter("repeats > 0").select(id_col, "source", "n_tokens", "repeats")


def report(counted: DataFrame, plan: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, wanted_share, actual_share, tokens, docs, max_repeats, available_tokens) of every named source."""
    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    took = plan.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.sum(F.least("copies", "docs")).alias("docs"))
    every = Window.partitionBy(F.lit(1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    t = targets_of(targets).join(have, "source", "left").join(took, "source", "left").select("source", "weight", "max_repeats", zero("available_tokens"), zero("tokens"), zero("docs"))
    return t.select("source", (F.col("weight") / F.sum("weight").over(every)).alias("wanted_share"), F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)).alias("actual_share"), "tokens", "docs", "max_repeats", "available_tokens")
