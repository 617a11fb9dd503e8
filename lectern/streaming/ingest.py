"""Incremental ingest and windows over event time. The batch operators are reused on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, per_trigger: int = 8) -> DataFrame:
    """A folder of parquet files as a stream, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def postings_sink(docs: DataFrame, key: str, fields: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Index documents as they arrive: each micro-batch appends its postings under its batch number, which a repeated batch overwrites."""
    from lectern.operators.retrieval import build

    def add(batch: DataFrame, n: int) -> None:
        build(batch, key, fields).postings.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str, by: list[str], value: str, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window of event time; rows later than the watermark are left out of a stream."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return g.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def citation_counts(links: DataFrame, target: str, source: str, ts: str, late: str = "1 day") -> DataFrame:
    """Running numbers of new citing papers by target and day; repeated pairs within the watermark count once."""
    once = links.withWatermark(ts, late).dropDuplicatesWithinWatermark([target, source])
    return once.groupBy(F.window(ts, "1 day").alias("w"), target).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), target, "n")
