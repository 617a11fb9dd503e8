"""Pivots, margins, statistics and set operations over result rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_means(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row a ``row`` value: the mean by column, then Mean and Max over the columns, and a row Mean and a row Max; rounded to 5.

    Max of a row is over its columns and its Mean; the row Max includes the row Mean. ``columns`` are the known column values.
    """
    p = rows.groupBy(row).pivot(column, columns).agg(F.avg(value))
    n = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))
    p = p.withColumn("Mean", F.try_divide(sum((F.coalesce(f"`{c}`", F.lit(0.0)) for c in columns), F.lit(0.0)), n))
    every = [*columns, "Mean"]
    mean = p.agg(F.lit("Mean").alias(row), *[F.avg(f"`{c}`").alias(c) for c in every])
    p = p.unionByName(mean)
    p = p.withColumn("Max", F.greatest(*[F.col(f"`{c}`") for c in every]))
    top = p.agg(F.lit("Max").alias(row), *[F.max(f"`{c}`").alias(c) for c in [*every, "Max"]])
    return p.unionByName(top).select(row, *[F.round(f"`{c}`", 5).alias(c) for c in [*every, "Max"]])


def best_method(rows: DataFrame, group: str, method: str, value: str) -> DataFrame:
    """The method of the best mean in each group, the least name at ties."""
    m = rows.groupBy(group, method).agg(F.avg(value).alias("mean"))
    w = Window.partitionBy(group).orderBy(F.desc("mean"), method)
    return m.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def zone_totals(rows: DataFrame, zone: Column) -> DataFrame:
    """Numbers of each zone with their part of all, and a row in total."""
    z = rows.groupBy(F.coalesce(zone, F.lit("none")).alias("zone")).agg(F.count("*").alias("n"))
    z = z.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return z.unionByName(z.agg(F.lit("total").alias("zone"), F.sum("n").alias("n"), F.sum("ratio").alias("ratio")))


def smoothed(rows: DataFrame, order: list[str], value: str, buckets: int) -> DataFrame:
    """Means over equal parts of the ordered rows: (bucket, n, mean)."""
    from lectern.operators.ranks import tiles

    t = tiles(rows.select(*order, value), order, buckets, "bucket")
    return t.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def consecutive_pairs(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Values of rows 1 and 2, 3 and 4, ... of each group beside one another; an odd last row is left out."""
    from lectern.operators.ranks import numbered

    t = numbered(rows.select(group, *order, F.col(value).alias("__v")), [F.coalesce(F.xxhash64(group), F.lit(0)), group, *order], "__no")
    starts = t.groupBy(F.col(group).alias("__group")).agg(F.min("__no").alias("__first"))
    # Groups are few or many, never large: one row each. Numbers are counted over all rows, so that a group of any size is numbered by many tasks.
    at = t.join(starts, F.col(group).eqNullSafe(F.col("__group"))).select(group, (F.col("__no") - F.col("__first")).alias("k"), "__v")
    odd = F.col("k") % 2 == 1
    p = at.groupBy(group, F.floor(F.col("k") / 2).alias("pair")).agg(F.max(F.when(~odd, F.col("__v"))).alias("first"), F.max(F.when(odd, F.col("__v"))).alias("second"))
    return p.where("second is not null").select(group, (F.col("pair") + 1).cast("int").alias("pair"), "first", "second")


def bootstrap(rows: DataFrame, groups: int, share: float, seed: int) -> DataFrame:
    """Rows drawn with replacement for each of ``groups`` groups; adds grp. A sampling operator: each row gets a Poisson number of copies in each group, in one reading."""
    u = F.col("__u")
    copies, term, upto = F.lit(0), math.exp(-share), 0.0
    for k in range(1, 24):
        upto += term
        copies = F.when(u >= upto, k).otherwise(copies)
        term *= share / k
    drawn = rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("__u", F.rand(seed))
    return drawn.withColumn("__k", copies).where("__k > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__k")))).drop("__u", "__k")


def suffixes(terms: DataFrame, term: str, n: Column, sizes: tuple[int, ...] = (2, 3, 4), most: int = 50) -> DataFrame:
    """(size, suffix, n): the most frequent endings of each size."""
    t = terms.select(F.col(term).alias("t"), n.alias("c"), F.explode(F.array(*map(F.lit, sizes))).alias("size")).where("length(t) > size")
    s = t.groupBy("size", F.expr("right(t, size)").alias("suffix")).agg(F.sum("c").alias("n"))
    w = Window.partitionBy("size").orderBy(F.desc("n"), "suffix")
    return s.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, on one side only, and the share of both in all."""
    x = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("a", F.lit(1))
    y = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("b", F.lit(1))
    n = x.join(y, key, "full").agg(F.sum((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")).alias("n_both"), F.count("*").alias("n_all"))
    return n.select(F.coalesce("n_both", F.lit(0)).alias("n_both"), (F.col("n_all") - F.coalesce("n_both", F.lit(0))).alias("n_one"), F.coalesce(F.try_divide("n_both", "n_all"), F.lit(0.0)).alias("share"))


def load_results(spark, pattern: str) -> DataFrame:  # noqa: ANN001
    """All result files of a pattern as one table, with unique_cit_id of file and citation; files with different columns are aligned by name."""
    t = spark.read.option("header", True).option("inferSchema", True).csv(pattern)
    return t.withColumn("unique_cit_id", F.concat_ws("_", F.coalesce("file_guid", F.lit("")), F.coalesce("citation_id", F.lit(""))))


def wide_rows(rows: DataFrame, unit: str, method: str, value: str, methods: list[str]) -> DataFrame:
    """One row a unit with a column for each method: repeated measures. Units without all methods are left out."""
    return rows.groupBy(unit).pivot(method, methods).agg(F.min(value)).na.drop(subset=methods)


def long_rows(rows: DataFrame, unit: str, method: str, value: str, best: DataFrame) -> DataFrame:
    """Rows of the methods chosen as best (method column): independent measures."""
    return rows.join(best.select(method).distinct(), method, "left_semi").select(unit, method, value)


def joined_results(parts: dict[str, DataFrame], unit: str, value: str) -> DataFrame:
    """Result tables by name, beside one another: one row a unit that all have."""
    long = None
    for name, df in parts.items():
        p = df.select(unit, F.lit(name).alias("part"), F.col(value).alias("value"))
        long = p if long is None else long.unionByName(p)
    return wide_rows(long, unit, "part", "value", list(parts))


def corpus_metadata(elements: DataFrame, zones: list[str], guid: str = "guid", zone: str = "zone") -> DataFrame:
    """One row a paper: elements, words, and elements of each known zone; 0 where there are none. Needs n_words."""
    counts = [F.count(F.when(F.col(zone) == z, 1)).alias(z) for z in zones]
    return elements.groupBy(guid).agg(F.count("*").alias("n_elements"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"), *counts)


def collection_totals(per_paper: DataFrame, zones: list[str]) -> DataFrame:
    """One row: papers, mean elements and words, and zones in sum."""
    return per_paper.agg(F.count("*").alias("n_papers"), F.avg("n_elements").alias("mean_elements"), F.avg("n_words").alias("mean_words"), *[F.coalesce(F.sum(z), F.lit(0)).alias(z) for z in zones])


def sankey(rows: DataFrame, cls: str, zones: list[str], scale: float = 50.0) -> DataFrame:
    """(source, weight, zone): edges of a flow from classes to zones, of positive weight."""
    return rows.unpivot(cls, zones, "zone", "w").where("w > 0").select(F.concat(F.col(cls), F.lit("-")).alias("source"), (F.col("w") * scale).alias("weight"), "zone")


def percent_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds pc_<column>: the column's part of their sum, in per cent; null where the sum is 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))
    return rows.withColumns({f"pc_{c}": F.try_divide(F.coalesce(F.col(c), F.lit(0)) * 100.0, total) for c in columns})


def label_statistics(rows: DataFrame, label: str, text: str) -> DataFrame:
    """(kind, label, n, n_unique): lines and different lines by whole label and by each of its letters."""
    whole = rows.select(F.lit("label").alias("kind"), F.col(label).alias("label"), F.col(text).alias("t"))
    letters = rows.select(F.lit("letter").alias("kind"), F.explode(F.array_distinct(F.split(label, ""))).alias("label"), F.col(text).alias("t")).where("label <> ''")
    return whole.unionByName(letters).groupBy("kind", "label").agg(F.count("*").alias("n"), F.countDistinct("t").alias("n_unique"))


def extracted_counts(tokens: DataFrame) -> DataFrame:
    """(token, n): how often each word is marked to be extracted."""
    return tokens.where("extract").groupBy("token").agg(F.count("*").alias("n"))


def unique_values(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """(value, n): what a pattern's first group meets in texts, with its number."""
    return rows.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def per_year(rows: DataFrame, year: Column) -> DataFrame:
    """(year, n): rows of each year, one row for those without."""
    return rows.groupBy(year.alias("year")).agg(F.count("*").alias("n"))


def union_keys(parts: list[DataFrame], key: str) -> DataFrame:
    """Distinct non-null keys of several tables."""
    out = None
    for p in parts:
        k = p.select(key).where(F.col(key).isNotNull())
        out = k if out is None else out.union(k)
    return out.distinct()
