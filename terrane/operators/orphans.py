"""References to records that don't exist, by keyed state that each arriving batch brings up to date.

The state has three tables: ``parents`` (each record that ever arrived, when it first did, whether its highest version
is live), ``owners`` (the highest version of each referring record) and ``refs`` (each reference of a live owner's
highest version with its status; those with a status are the pending orphans). A batch

* withdraws the references of owners of which it holds a higher version,
* probes the parents with the new references,
* and lets its changed parents meet the waiting references: an arrival resolves them, a deletion reopens them.

References that none of this touches keep their status, though a batch reads and writes the state whole. Every step is a join on a key that spreads evenly or a
hash aggregate, so it runs on any number of tasks; a target that a third of all references name is split by the join
(adaptive skew handling splits the references, the parent's side has one row a key).

Status: 1 no row at all, 2 not live, 3 first arrived after the owner's version did.

Defined results: rows delivered again change nothing but may lower the arrival; null ids of owners are no records; null
references and members with null type or ref aren't cases, but count for the position; owners without references, empty
tables and extra columns are fine; a reference named at several positions is several rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.versions import live, version
from terrane.session import materialize, release

NODE, WAY, RELATION = 0, 1, 2
REASONS = {1: "missing", 2: "deleted", 3: "late"}


@dataclass
class OrphanState:
    parents: DataFrame | None = None
    owners: DataFrame | None = None
    refs: DataFrame | None = None


def _arrived(tables: dict[int, DataFrame]) -> DataFrame:
    """(kind, id, first_at, code) from the rows of a batch; ``code`` is twice the highest version, plus 1 if live."""
    code = version().cast("bigint") * 2 + live().cast("bigint")
    parts = [df.select(F.lit(kind).cast("tinyint").alias("kind"), "id", F.col("loaded_at").alias("first_at"), code.alias("code")) for kind, df in tables.items()]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionAll(x)
    return rows.filter(F.col("id").isNotNull()).groupBy("kind", "id").agg(F.min("first_at").alias("first_at"), F.max("code").alias("code"))


def _owned(tables: dict[int, DataFrame]) -> DataFrame:
    """(kind, id, version, since, live, month, refs) of the highest version of each way and relation of a batch."""
    target = "array<struct<type:tinyint,ref:bigint>>"
    parts = []
    for kind, df in tables.items():
        if kind == WAY:
            refs = F.transform("refs", lambda r: F.struct(F.lit(NODE).cast("tinyint").alias("type"), r.alias("ref")))
        elif kind == RELATION:
            refs = F.transform("members", lambda m: F.struct(m["type"].cast("tinyint").alias("type"), m["ref"].cast("bigint").alias("ref")))
        else:
            continue
        best = F.struct(version().alias("version"), (-F.unix_micros("loaded_at")).alias("back"), live().alias("live"), F.date_format("ts", "yyyy-MM").alias("month"), refs.cast(target).alias("refs"))
        parts.append(df.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(best).alias("b")).select(F.lit(kind).cast("tinyint").alias("kind"), "id", "b.version", F.timestamp_micros(-F.col("b.back")).alias("since"), "b.live", "b.month", "b.refs"))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionAll(x)
    return rows


def _status(first_at: Column, code: Column, since: Column) -> Column:
    missing = F.when(code.isNull(), 1).when(F.pmod(code, F.lit(2)) == 0, 2).when(first_at > since, 3)
    return missing.cast("tinyint")


def advance(state: OrphanState, batch: dict[int, DataFrame]) -> OrphanState:
    """The state after a batch of rows: ``batch`` has a table for each kind (0 nodes, 1 ways, 2 relations)."""
    came, owned = _arrived(batch), _owned(batch)
    if state.parents is None:
        parents, changed = materialize(came), None
        fresh = materialize(owned)
        owners = fresh.select("kind", "id", "version", "since")
    else:
        old = state.parents.select("kind", "id", F.col("first_at").alias("old_at"), F.col("code").alias("old_code"))
        both = came.join(old, ["kind", "id"], "full_outer")
        at, code = F.least("first_at", "old_at"), F.greatest("code", "old_code")
        alive = lambda c: F.pmod(c, F.lit(2))
        moved = F.col("old_code").isNull() | (at < F.col("old_at")) | (alive(code) != alive(F.col("old_code")))
        parents = materialize(both.select("kind", "id", at.alias("first_at"), code.alias("code"), F.coalesce(moved & F.col("code").isNotNull(), F.lit(False)).alias("changed")))
        changed = parents.filter("changed").select(F.col("kind").alias("type"), F.col("id").alias("ref"), "first_at", "code")
        held = state.owners.select("kind", "id", F.col("version").alias("old_version"), F.col("since").alias("old_since"))
        ahead = F.col("old_version").isNull() | (F.col("version") > F.col("old_version")) | ((F.col("version") == F.col("old_version")) & (F.col("since") < F.col("old_since")))
        fresh = materialize(owned.join(held, ["kind", "id"], "left").filter(ahead).drop("old_version", "old_since"))
        owners = state.owners.select("kind", "id", "version", "since").join(fresh.select("kind", "id"), ["kind", "id"], "left_anti").unionAll(fresh.select("kind", "id", "version", "since"))

    new = fresh.filter("live").select("kind", "id", "since", "month", F.posexplode("refs").alias("pos", "x")).select("kind", "id", "pos", F.col("x.type").alias("type"), F.col("x.ref").alias("ref"), "since", "month")
    new = new.filter(F.col("type").isNotNull() & F.col("ref").isNotNull())
    index = parents.select(F.col("kind").alias("type"), F.col("id").alias("ref"), "first_at", "code")
    status = _status(F.col("first_at"), F.col("code"), F.col("since")).alias("status")
    columns = ["kind", "id", "pos", "type", "ref", "since", "month"]
    refs = new.join(index, ["type", "ref"], "left").select(*columns, status)
    if changed is not None:
        kept = state.refs.join(fresh.select("kind", "id"), ["kind", "id"], "left_anti").join(changed, ["type", "ref"], "left")
        refs = refs.unionAll(kept.select(*columns, F.when(F.col("code").isNull(), F.col("status")).otherwise(_status(F.col("first_at"), F.col("code"), F.col("since"))).alias("status")))
    refs = materialize(refs)
    owners = owners if state.owners is None else materialize(owners)
    release(state.parents, state.owners, state.refs)
    if state.owners is not None:
        release(fresh)
    return OrphanState(parents, owners, refs)


def orphans(state: OrphanState) -> DataFrame:
    """(kind, id, pos, type, ref, month, reason): the pending orphans of the state."""
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("status").cast("int"))
    return state.refs.filter(F.col("status").isNotNull()).select(F.col("kind").cast("int").alias("kind"), "id", "pos", F.col("type").cast("int").alias("type"), "ref", "month", reason.alias("reason"))


def report(state: OrphanState) -> DataFrame:
    """(kind, type, month, references): the orphans of each referring table, target kind and month of ``ts``."""
    return orphans(state).groupBy("kind", "type", "month").agg(F.count(F.lit(1)).alias("n_refs"))


def batches(tables: dict[int, DataFrame], n: int) -> list[dict[int, DataFrame]]:
    """The tables cut into ``n`` batches by equal spans of arrival time. Rows without a time are in the first."""
    if n == 1:
        return [tables]
    bounds = None
    for df in tables.values():
        one = df.agg(F.min("loaded_at").alias("lo"), F.max("loaded_at").alias("hi"))
        bounds = one if bounds is None else bounds.unionAll(one)
    lo, hi = bounds.agg(F.unix_micros(F.min("lo")), F.unix_micros(F.max("hi"))).first()
    if lo is None:
        return [tables]
    cuts = [lo + (hi + 1 - lo) * i // n for i in range(n + 1)]
    at = F.col("loaded_at")
    when = lambda i: F.timestamp_micros(F.lit(cuts[i]))  # noqa: E731  # folded to a literal, which the scan can skip row groups by

    def span(i: int) -> Column:
        within = (at >= when(i)) & (at < when(i + 1))
        return within | at.isNull() if i == 0 else within

    return [{k: df.filter(span(i)) for k, df in tables.items()} for i in range(n)]


def replay(tables: dict[int, DataFrame], n: int, snapshot=None) -> OrphanState:
    """Bring the whole tables through the state in ``n`` batches; ``snapshot(i, state)`` is called after each."""
    state = OrphanState()
    for i, batch in enumerate(batches(tables, n)):
        state = advance(state, batch)
        if snapshot:
            snapshot(i, state)
    return state
