"""Ranking metrics of retrieved lists against the documents that match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rank of a match that was not found, where ranks are averaged.
FAR = 200


def measure(ranked: DataFrame, matches: DataFrame, far: int = FAR) -> DataFrame:
    """(query_id, mrr, precision, ndcg, rank, map) for each query with matches and at least one retrieved document.

    ``ranked``: query_id, guid, rank from 1 without gaps; ``matches``: query_id, guid. With one match, precision asks for rank 1; with m
    matches, ranks up to m count as full hits. A missing match scores 0 and rank ``far``; rank is the truncated mean. map sums found / i over all
    ranks to the last hit (to the end if one is missing), over m. Repeated guids count at their first rank.
    """
    first = ranked.groupBy("query_id", "guid").agg(F.min("rank").alias("rank"))
    m = matches.select("query_id", "guid").distinct()
    size = m.groupBy("query_id").agg(F.count("*").alias("m"))
    length = first.groupBy("query_id").agg(F.max("rank").alias("n"))
    # Matches may be many: while sizes aren't known yet, the adaptive planner would build them as a broadcast in the driver.
    base = m.join(size.hint("merge"), "query_id").join(length.hint("merge"), "query_id").join(first.hint("merge"), ["query_id", "guid"], "left")
    r, many = F.col("rank"), F.col("m") > 1
    full = many & (r <= F.col("m"))
    ndcg = F.when(r.isNull(), 0.0).when(full, 1.0).otherwise(F.ln(F.lit(2.0)) / F.ln(1.0 + r))
    precision = F.when(r.isNull(), 0.0).when(full | (~many & (r == 1)), 1.0).otherwise(0.0)
    mrr = F.when(r.isNull(), 0.0).when(full, 1.0).otherwise(1.0 / r)
    rank = F.when(r.isNull(), far).when(full, 1).otherwise(r)
    # map: each hit adds 1 to found at all ranks from its own to the stop, so it adds H(stop) - H(rank - 1).
    stop = F.when(F.count("rank").over(Window.partitionBy("query_id")) == F.col("m"), F.max("rank").over(Window.partitionBy("query_id"))).otherwise(F.col("n"))
    harmonic = F.when(r.isNull(), 0.0).otherwise(F.aggregate(F.sequence(r.cast("int"), stop.cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / i))
    per = base.select("query_id", "m", ndcg.alias("ndcg"), precision.alias("precision"), mrr.alias("mrr"), rank.alias("rank"), harmonic.alias("h"))
    return per.groupBy("query_id").agg(
        F.avg("mrr").alias("mrr"), F.avg("precision").alias("precision"), F.avg("ndcg").alias("ndcg"), F.floor(F.sum("rank") / F.first("m")).cast("bigint").alias("rank"), (F.sum("h") / F.first("m")).alias("map")
    )


def with_empty(measured: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries that retrieved nothing get zero scores and rank 0, and are told apart by retrieved_any."""
    full = queries.select("query_id").distinct().join(measured, "query_id", "left")
    return full.select("query_id", F.col("mrr").isNotNull().alias("retrieved_any"), *[F.coalesce(c, F.lit(0)).cast(measured.schema[c].dataType).alias(c) for c in ("mrr", "precision", "ndcg", "rank", "map")])


def averages(measured: DataFrame, by: list[str]) -> DataFrame:
    return measured.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(f"avg_{c}") for c in ("mrr", "precision", "ndcg", "rank", "map")])


def summary(measured: DataFrame, query_method: str, doc_method: str, metric: str = "mrr") -> DataFrame:
    """Per document method the mean over query methods of their means."""
    return measured.groupBy(doc_method, query_method).agg(F.avg(metric).alias("a")).groupBy(doc_method).agg(F.avg("a").alias(f"mean_{metric}"), F.count("*").alias("n_query_methods"))


def method_overlap(measured: DataFrame, method: str, key: str = "query_id", value: str = "rank") -> DataFrame:
    """The share of queries for which all methods agree on the value."""
    same = measured.groupBy(key).agg((F.countDistinct(value) <= 1).cast("int").alias("same"))
    return same.agg(F.avg("same").alias("overlap"), F.count("*").alias("n_queries"))


def random_control(ranked: DataFrame) -> DataFrame:
    """What chance would give for each query: mean reciprocal rank and precision over its retrieved number."""
    from lectern.functions.text import chance_mrr

    n = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    return n.select("query_id", "n", chance_mrr("n").alias("mrr"), (1.0 / F.col("n")).alias("precision"))


def set_scores(predicted: DataFrame, gold: DataFrame, key: str, item: str) -> DataFrame:
    """Precision, recall and F1 of predicted items against gold ones for each key that has either."""
    p = predicted.select(key, item).distinct().withColumn("p", F.lit(1))
    g = gold.select(key, item).distinct().withColumn("g", F.lit(1))
    n = p.join(g, [key, item], "full").groupBy(key).agg(F.sum(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0)).alias("tp"), F.count("p").alias("np"), F.count("g").alias("ng"))
    pr, rc = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0), F.when(F.col("ng") > 0, F.col("tp") / F.col("ng")).otherwise(0.0)
    return n.select(key, pr.alias("precision"), rc.alias("recall"), F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0).alias("f1"))


def tied_best(measured: DataFrame, method: str, value: str) -> DataFrame:
    """Mean over the rows that tie with the best value of their method."""
    w = Window.partitionBy(method).orderBy(F.desc(value))
    return measured.withColumn("k", F.rank().over(w)).where("k = 1").groupBy(method).agg(F.avg(value).alias("best"), F.count("*").alias("n_tied"))
