"""Skewed keys and orphan references, against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators import orphans, skew

LINKS = "link_id bigint, GUID_from string, GUID_to string, time_created timestamp_ntz, guid string"
PAPERS = "GUID string, num_inlinks int, norm_title string, time_created timestamp_ntz, time_deleted timestamp_ntz, link_id int"


def _brute(links, papers):
    key = lambda g: None if g is None else g.strip().lower()
    out = {}
    for p in papers:
        if p[0] is not None:
            k = key(p[0])
            n = len({key(x[1]) for x in links if key(x[2]) == k and x[1] is not None})
            old = out.get(k)
            out[k] = (min(p[0], old[0]) if old else p[0], n)
    return sorted(out.values())


def test_distinct_citing_with_a_hot_key(spark):
    r = random.Random(1)
    t = datetime(2020, 1, 1)
    links = [(i, r.choice([f"F{r.randrange(300)}", f" f{r.randrange(300)} ", None]), "HOT" if r.random() < 0.7 else r.choice(["hot ", f"P{r.randrange(40)}", None, ""]), t, "x") for i in range(4000)]
    papers = [(g, 1, "t", t, None, 7) for g in ["Hot", "hot", *[f"p{i}" for i in range(45)], None]]
    got = skew.citing_counts(spark.createDataFrame(links, LINKS), spark.createDataFrame(papers, PAPERS)).select("guid", "n_citing").collect()
    assert sorted(map(tuple, got)) == _brute(links, papers)


def test_plan_splits_hot_keys_and_balances(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    plan = skew.plan_shards(rows, "k", 8)
    assert set(plan.heavy) == {"hot"} and len(set(plan.heavy["hot"])) > 3
    placed = skew.fragment(rows.withColumn("v", F.rand(1)), "k", F.col("v"), plan)
    loads = [r["n"] for r in placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(loads) < 2 * 40_000 / 8


def test_empty_tables(spark):
    got = skew.citing_counts(spark.createDataFrame([], LINKS), spark.createDataFrame([("a", 1, None, None, None, 1)], PAPERS)).collect()
    assert [(r["guid"], r["n_citing"]) for r in got] == [("a", 0)]
    assert skew.citing_counts(spark.createDataFrame([], LINKS), spark.createDataFrame([], PAPERS)).count() == 0
    m = spark.createDataFrame([], "missing_id bigint, norm_title string, time_created timestamp_ntz")
    assert orphans.corpus_orphans(spark.createDataFrame([], LINKS), m, spark.createDataFrame([], PAPERS)).count() == 0


def test_orphans_against_brute_force(spark):
    r = random.Random(2)
    day = lambda: None if r.random() < 0.03 else datetime(2020, 1, 1) + timedelta(hours=r.randrange(2000))
    keys = ["hot"] * 8 + [f"k{i}" for i in range(12)]
    papers = [(r.choice([*keys, None, " "]), 0, r.choice([*keys, "", None]), day(), r.choice([None, day()]), 1) for _ in range(60)]
    links = [(i, "f", r.choice([*keys, "HOT ", "none", None, " "]), day(), "x") for i in range(600)]
    missing = [(i, r.choice([*keys, "none", "", None]), day()) for i in range(200)]

    def judge(key, t, col, norm):
        if key is None or not key.strip():
            return None
        own = [p for p in papers if p[col] is not None and norm(p[col]) == norm(key)]
        if t is not None and any(p[3] is not None and p[3] <= t and (p[4] is None or p[4] > t) for p in own):
            return None
        return "missing" if not own else "deleted" if t is not None and any(p[4] is not None and p[4] <= t for p in own) else "late"

    want = set()
    for i, _, k, t, _x in links:
        if reason := judge(k, t, 0, lambda s: s.strip().lower()):
            want.add(("links", i, t.strftime("%Y-%m") if t else None, reason))
    for i, k, t in missing:
        if reason := judge(k, t, 2, lambda s: s):
            want.add(("missing_papers", i, t.strftime("%Y-%m") if t else None, reason))
    for slices in (1, 40):
        L, M, P = spark.createDataFrame(links, LINKS), spark.createDataFrame(missing, "missing_id bigint, norm_title string, time_created timestamp_ntz"), spark.createDataFrame(papers, PAPERS)
        from lectern.functions.keys import guid_key

        got = orphans.orphans(
            [orphans.Parent("g", P, guid_key("GUID"), F.col("time_created"), F.col("time_deleted")), orphans.Parent("t", P, F.col("norm_title"), F.col("time_created"), F.col("time_deleted"))],
            [orphans.Reference("links", "g", L, F.col("link_id"), guid_key("GUID_to"), F.col("time_created")), orphans.Reference("missing_papers", "t", M, F.col("missing_id"), F.col("norm_title"), F.col("time_created"))],
            slices,
        )
        rows = list(map(tuple, got.collect()))
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_orphan_keys_without_time(spark):
    c, p = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string"), spark.createDataFrame([("b",), (None,)], "k string")
    assert list(map(tuple, orphans.orphan_keys(c, "k", p, "k").collect())) == [("a", 2)]


def test_numbers_and_tiles(spark):
    from lectern.operators.ranks import numbered, tiles

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("row"))
    got = {r["v"]: r["row_no"] for r in numbered(rows, ["v"]).collect()}
    assert got == {v: v + 1 for v in range(1000)}
    t = tiles(spark.range(10), ["id"], 4).groupBy("tile").count().collect()
    assert sorted(map(tuple, t)) == [(1, 3), (2, 3), (3, 2), (4, 2)]
    assert tiles(spark.range(2), ["id"], 4).count() == 2 and numbered(spark.range(0), ["id"]).count() == 0
