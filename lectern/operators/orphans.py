"""References to records that do not exist.

Parents and children are unioned, tagged, in long form (kind, key, time) and grouped by parent table and key; a child is kept
where its group holds no parent that was there at its time. Whether a parent was there at time t is a running maximum: some
parent with created <= t and deleted > t exists exactly if the greatest ``deleted`` among those created by t lies after t (null
counts as for ever). The running maximum is taken in two levels, within (key, slice of time) and over the slices of a key, so
that a key with a third of all rows is spread over the slices; slices are cut at quantiles of the children's times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.keys import guid_key, is_blank

_FOREVER = "timestamp_ntz'9999-12-31 00:00:00'"
SLICES = 256


@dataclass(frozen=True)
class Reference:
    """Children of one table: ``kind`` names the parent table and key they point to."""

    table: str
    kind: str
    rows: DataFrame
    row_id: Column
    key: Column
    time: Column


@dataclass(frozen=True)
class Parent:
    kind: str
    rows: DataFrame
    key: Column
    created: Column
    deleted: Column


def orphan_keys(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Keys of ``children`` that ``parents`` lacks, without regard to time: (key, n_rows).

    Both sides are reduced to tagged partial counts before the one shuffle on the key. Null keys refer to nothing and are left out.
    """
    long = children.select(F.col(child_key).alias("key"), F.lit(0).alias("parent"), F.lit(1).alias("child")).unionByName(
        parents.select(F.col(parent_key).alias("key"), F.lit(1).alias("parent"), F.lit(0).alias("child"))
    )
    grouped = long.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("parent").alias("parent"), F.sum("child").alias("n_rows"))
    return grouped.where((F.col("parent") == 0) & (F.col("n_rows") > 0)).select("key", "n_rows")


def _cuts(children: DataFrame, slices: int) -> list[int]:
    """Quantiles of the children's times in microseconds; at most ``slices`` - 1 numbers."""
    q = [i / slices for i in range(1, slices)]
    if not q:
        return []
    found = children.where(F.col("t").isNotNull()).select(F.unix_micros(F.col("t").cast("timestamp")).cast("double").alias("u")).approxQuantile("u", q, 0.002)
    return sorted({int(x) for x in found})


def _slice_of(time: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the time: first among every 16th cut, then among the 16 that follow."""
    if not cuts:
        return F.lit(0)
    at = F.unix_micros(time.cast("timestamp"))
    constant = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    coarse = constant(cuts[15::16]) if len(cuts) > 15 else F.array().cast("array<bigint>")
    block = F.size(F.filter(coarse, lambda c: c <= at)) * 16
    return block + F.size(F.filter(F.slice(constant(cuts), block + 1, 16), lambda c: c <= at))


def orphans(parents: list[Parent], references: list[Reference], slices: int = SLICES) -> DataFrame:
    """Each referring row whose key no parent had at the row's time: ref_table, row_id, period, reason.

    Rows whose key is null or blank refer to nothing and are left out. A row without a time is an orphan with null period. A parent
    without a creation time was never there; without a deletion time it is still there. reason is ``missing`` if no
    parent ever had the key, else ``deleted`` if one of them was deleted by the row's time, else ``late``. Repeated rows each count.
    Columns of the same name in several tables do not clash: only the given expressions are read.
    """
    child = None
    for r in references:
        part = r.rows.select(
            F.lit(r.kind).alias("kind"), r.key.alias("key"), r.time.cast("timestamp_ntz").alias("t"), F.lit(r.table).alias("ref_table"), r.row_id.cast("bigint").alias("row_id")
        ).where(~is_blank("key"))
        child = part if child is None else child.unionByName(part)
    parent = None
    for p in parents:
        part = p.rows.select(F.lit(p.kind).alias("kind"), p.key.alias("key"), p.created.cast("timestamp_ntz").alias("t"), p.deleted.cast("timestamp_ntz").alias("deleted")).where(~is_blank("key"))
        parent = part if parent is None else parent.unionByName(part)
    cuts = _cuts(child, slices)
    child = child.withColumn("slice", F.when(F.col("t").isNull(), F.lit(-1)).otherwise(_slice_of(F.col("t"), cuts)))
    parent = parent.withColumn("slice", F.when(F.col("t").isNull(), F.lit(-1)).otherwise(_slice_of(F.col("t"), cuts)))

    # Level 2: per key and slice what earlier slices leave behind. At most ``slices`` + 1 rows a key.
    state = parent.groupBy("kind", "key", "slice").agg(
        F.max(F.when(F.col("t").isNotNull(), F.coalesce("deleted", F.expr(_FOREVER)))).alias("ends"), F.min("deleted").alias("first_deleted")
    )
    # A slice with children but no parents needs a row too: tagged keys of both sides, pre-aggregated.
    spots = child.groupBy("kind", "key", "slice").agg(F.lit(None).cast("timestamp_ntz").alias("ends"), F.lit(None).cast("timestamp_ntz").alias("first_deleted"), F.lit(0).alias("parent"), F.lit(1).alias("child"))
    state = state.withColumn("parent", F.lit(1)).withColumn("child", F.lit(0)).unionByName(spots)
    state = state.groupBy("kind", "key", "slice").agg(*[F.max(c).alias(c) if c != "first_deleted" else F.min(c).alias(c) for c in ("ends", "first_deleted", "parent", "child")])
    over = Window.partitionBy("kind", "key").orderBy("slice")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("kind", "key")
    state = state.select(
        "kind", "key", "slice", "child", F.max("ends").over(before).alias("carried"), F.max("parent").over(whole).alias("known"), F.min("first_deleted").over(whole).alias("first_deleted")
    ).where("child = 1").drop("child")

    # Level 1: within (key, slice) the union of tagged rows in order of time, parents first at equal times.
    long = child.select("kind", "key", "slice", "t", F.lit(1).alias("tag"), F.lit(None).cast("timestamp_ntz").alias("ends"), "ref_table", "row_id").unionByName(
        parent.where("t is not null").select("kind", "key", "slice", "t", F.lit(0).alias("tag"), F.coalesce("deleted", F.expr(_FOREVER)).alias("ends"), F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("bigint").alias("row_id"))
    )
    here = Window.partitionBy("kind", "key", "slice").orderBy("t", "tag").rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumn("ends", F.max("ends").over(here)).where("tag = 1")
    joined = long.join(state, ["kind", "key", "slice"])
    alive = F.coalesce(F.greatest("ends", "carried") > F.col("t"), F.lit(False))
    reason = F.when(F.col("known") == 0, "missing").when(F.coalesce(F.col("first_deleted") <= F.col("t"), F.lit(False)), "deleted").otherwise("late")
    return joined.where(~alive).select("ref_table", "row_id", F.date_format("t", "yyyy-MM").alias("period"), reason.alias("reason"))


def corpus_orphans(links: DataFrame, missing: DataFrame, papers: DataFrame) -> DataFrame:
    """``orphans`` of links.GUID_to (by ``guid_key``) and missing_papers.norm_title (as it stands) against papers."""
    return orphans(
        [
            Parent("papers.GUID", papers, guid_key("GUID"), F.col("time_created"), F.col("time_deleted")),
            Parent("papers.norm_title", papers, F.col("norm_title"), F.col("time_created"), F.col("time_deleted")),
        ],
        [
            Reference("links", "papers.GUID", links, F.col("link_id"), guid_key("GUID_to"), F.col("time_created")),
            Reference("missing_papers", "papers.norm_title", missing, F.col("missing_id"), F.col("norm_title"), F.col("time_created")),
        ],
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of ``orphans`` per table, period and reason."""
    return found.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_rows"))
