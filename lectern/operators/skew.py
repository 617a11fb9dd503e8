"""Per-key results where a few keys hold most rows.

Fragment-replicate by estimated load: the load of every key is counted with map-side combining; light keys are hashed into a
fixed number of bins, heavy keys are cut into shards in proportion to their load, and bins and shards are packed onto tasks,
largest first. The other side of a join is replicated only to the shards of the heavy keys.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.session import tasks as default_tasks

BINS = 4096


@dataclass(frozen=True)
class ShardPlan:
    """``bin_task[b]`` is the task of bin b; ``heavy[key]`` lists the task of each of the key's shards.

    The driver holds BINS numbers and, since a heavy key has more than a task's share of the rows, fewer heavy keys than tasks.
    """

    tasks: int
    bin_task: list[int]
    heavy: dict[str, list[int]]


def pack(loads: list[tuple[int, object]], n: int) -> dict[object, int]:
    """Longest-processing-time packing of (load, item) onto n tasks."""
    heap = [(0, t) for t in range(n)]
    out = {}
    for load, item in sorted(loads, key=lambda x: (-x[0], str(x[1]))):
        total, t = heapq.heappop(heap)
        out[item] = t
        heapq.heappush(heap, (total + load, t))
    return out


def plan_shards(rows: DataFrame, key: str, n: int | None = None) -> ShardPlan:
    """Count the load of every key and pack. Rows with a null key are left out of the plan."""
    n = n or default_tasks(rows.sparkSession)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    binned = counts.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(BINS)).cast("int"))
    per_bin = binned.groupBy("__b").agg(F.sum("__n").alias("load"), F.max("__n").alias("top")).collect()
    total = sum(r.load for r in per_bin)
    target = max(1, math.ceil(total / n))
    heavy_bins = [r["__b"] for r in per_bin if r.top > target]
    heavy_rows = binned.where(F.col("__b").isin(heavy_bins) & (F.col("__n") > target)).collect() if heavy_bins else []
    light = {r["__b"]: r.load for r in per_bin}
    loads: list[tuple[int, object]] = []
    for r in heavy_rows:
        shards = min(4 * n, math.ceil(2 * r["__n"] / target))
        loads += [(r["__n"] // shards, (r[key], s)) for s in range(shards)]
        light[r["__b"]] -= r["__n"]
    placed = pack(loads + [(v, b) for b, v in light.items()], n)
    heavy: dict[str, list[int]] = {}
    for r in heavy_rows:
        own = sorted((i[1], t) for i, t in placed.items() if isinstance(i, tuple) and i[0] == r[key])
        heavy[r[key]] = [t for _, t in own]
    return ShardPlan(n, [placed.get(b, b % n) for b in range(BINS)], heavy)


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, block: int) -> DataFrame:
    """Inner join in which the right side of a key with more than ``block`` rows is spread by the hash of its column ``by`` over shards of about ``block``,
    each of which meets the whole left side of the key; no task gets a whole heavy key. Null keys meet nothing."""
    heavy = right.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("__n")).where(F.col("__n") > block).select(on, F.ceil(F.col("__n") / block).cast("int").alias("__k"))
    k = F.coalesce("__k", F.lit(1))
    one = left.join(heavy, on, "left").withColumn("__shard", F.explode(F.sequence(F.lit(0), k - 1))).drop("__k")
    two = right.join(heavy, on, "left").withColumn("__shard", F.pmod(F.xxhash64(by), k).cast("int")).drop("__k")
    return one.join(two, [on, "__shard"]).drop("__shard")


def _heavy_table(like: DataFrame, key: str, plan: ShardPlan) -> DataFrame:
    spark = like.sparkSession
    return spark.createDataFrame(list(plan.heavy.items()), f"`{key}` string, __tasks array<int>")


def _bin_task(key: str, plan: ShardPlan) -> Column:
    bins = F.split(F.lit(",".join(map(str, plan.bin_task))), ",").cast("array<int>")
    return bins[F.pmod(F.xxhash64(key), F.lit(BINS)).cast("int")]


def fragment(rows: DataFrame, key: str, spread: Column, plan: ShardPlan) -> DataFrame:
    """Place ``rows`` on their tasks; rows of a heavy key go to the shard given by the hash of ``spread``. Adds __task and __shard."""
    placed = rows.join(F.broadcast(_heavy_table(rows, key, plan)), key, "left")
    shard = F.when(F.col("__tasks").isNotNull(), F.pmod(F.xxhash64(spread), F.size("__tasks").cast("long")).cast("int")).otherwise(0)
    placed = placed.withColumn("__shard", shard)
    placed = placed.withColumn("__task", F.coalesce(F.col("__tasks")[F.col("__shard")], _bin_task(key, plan))).drop("__tasks")
    return placed.repartitionById(plan.tasks, F.col("__task"))


def replicate(rows: DataFrame, key: str, plan: ShardPlan) -> DataFrame:
    """Place the other side: a row of a light key once, a row of a heavy key on each of the key's shards."""
    placed = rows.join(F.broadcast(_heavy_table(rows, key, plan)), key, "left")
    at = F.coalesce("__tasks", F.array(_bin_task(key, plan)))
    placed = placed.select(*rows.columns, F.posexplode(at).alias("__shard", "__task"))
    return placed.repartitionById(plan.tasks, F.col("__task"))


def distinct_per_key(rows: DataFrame, key: str, value: str, other: DataFrame, plan: ShardPlan | None = None) -> DataFrame:
    """For each key of ``other`` (one row per key) the number of distinct non-null ``value`` among ``rows`` with that key.

    Shards of a heavy key are cut by the hash of the value, so their distinct counts add up exactly. Keys of ``other``
    without rows get 0; rows with a null key or value count for nothing; keys absent from ``other`` are left out;
    empty tables give an empty result or zeros. Returns the columns of ``other`` and ``n_distinct``.
    """
    plan = plan or plan_shards(rows, key)
    pairs = rows.select(key, value).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    at = ["__task", "__shard", key]
    part = fragment(pairs, key, F.col(value), plan).groupBy(*at, value).agg(F.lit(1).alias("__one")).groupBy(*at).agg(F.count("__one").alias("__part"))
    own = replicate(other, key, plan)
    joined = own.join(part, at, "left")
    names = [c for c in other.columns if c != key]
    return joined.groupBy(key).agg(F.sum(F.coalesce("__part", F.lit(0))).alias("n_distinct"), *[F.first(c).alias(c) for c in names])


def citing_counts(links: DataFrame, papers: DataFrame) -> DataFrame:
    """Every GUID of ``papers`` with its number of distinct citing papers and its stored counts.

    Columns guid (as written in ``papers``; the least spelling if several), n_citing, least_stored, most_stored. GUIDs compare
    by ``guid_key``; papers without a GUID are left out.
    """
    from lectern.functions.keys import guid_key

    pairs = links.select(guid_key("GUID_to").alias("key"), guid_key("GUID_from").alias("citing"))
    own = papers.where(F.col("GUID").isNotNull()).groupBy(guid_key("GUID").alias("key")).agg(
        F.min("GUID").alias("guid"), F.min("num_inlinks").alias("least_stored"), F.max("num_inlinks").alias("most_stored")
    )
    return distinct_per_key(pairs, "key", "citing", own).select("guid", F.col("n_distinct").alias("n_citing"), "least_stored", "most_stored")
