"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.session import tasks, written

_ROW_BITS = 33


def numbered(rows: DataFrame, order: list[str | Column], name: str = "row_no") -> DataFrame:
    """Adds the row's number from 1 in the order. Rows are cut into ranges and sorted there; a range begins where those before it end.

    The sorted rows are written once, since the cuts of a second evaluation may differ. The driver sees one count a range.
    """
    return running(rows, order, F.lit(1), name)


def running(rows: DataFrame, order: list[str | Column], step: Column, name: str = "total") -> DataFrame:
    """Adds the sum of ``step`` over the rows up to and with each, in the order; sorted and written as for ``numbered``. Null steps count 0."""
    n = tasks(rows.sparkSession)
    placed = rows.withColumn("__step", F.coalesce(step.cast("bigint"), F.lit(0))).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = written(placed, "numbered").withColumn("__range", F.shiftright("__id", _ROW_BITS))
    sizes = {r["__range"]: r["n"] for r in placed.groupBy("__range").agg(F.sum("__step").alias("n")).collect()}
    before, starts = 0, []
    for k in sorted(sizes):
        starts.append((int(k), before))
        before += sizes[k]
    table = rows.sparkSession.createDataFrame(starts, "__range bigint, __start bigint")
    within = F.sum("__step").over(Window.partitionBy("__range").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(table), "__range").withColumn(name, F.col("__start") + within).drop("__id", "__range", "__start", "__step")


def tiles(rows: DataFrame, order: list[str | Column], k: int, name: str = "tile") -> DataFrame:
    """Adds the number, from 1, of the row's part among k equal parts in the order; the first n mod k parts are one longer."""
    t = numbered(rows, order, "__no")
    n = t.count()
    q, r = divmod(n, k)
    at = F.col("__no") - 1
    long = r * (q + 1)
    part = F.when(at < long, F.floor(at / (q + 1))).otherwise(r + F.floor((at - long) / max(q, 1)))
    return t.withColumn(name, part.cast("int") + 1).drop("__no")
