"""Scoring and choosing the words of a query that lead to the papers it cites."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import sigmoid

if TYPE_CHECKING:
    from lectern.operators.retrieval import Index


#: Points of running sums that one broadcast holds.
CURVE_POINTS = 3_000_000


def term_scores(hits: DataFrame, how: str = "max") -> DataFrame:
    """(query_id, guid, term, score): each term's part in each document's score, its fields combined by max or sum."""
    f = {"max": F.max, "add": F.sum}[how]
    return hits.groupBy("query_id", "guid", "term").agg(f(F.col("qw") * F.col("fw")).alias("score"))


def normalised(scores: DataFrame, matches: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """(query_id, guid, term, score) for matching documents: share of the document's score, over (1 + the term's sum over the retrieved)^2, shared out to sum 1.

    ``scores`` has the term scores of the matching and of the retrieved documents; ``retrieved``: query_id, guid, all of ``scores`` without it.
    Matches grow with the documents, so they aren't broadcast, whatever the session's threshold.
    """
    listed = scores if retrieved is None else scores.join(retrieved.select("query_id", "guid").distinct().hint("merge"), ["query_id", "guid"], "left_semi")
    sums = listed.groupBy("query_id", "term").agg(F.sum("score").alias("raw"))
    own = scores.join(matches.select("query_id", "guid").distinct().hint("merge"), ["query_id", "guid"], "left_semi").join(sums, ["query_id", "term"], "left")
    doc = Window.partitionBy("query_id", "guid")
    own = own.withColumn("s", F.col("score") / F.sum("score").over(doc) / F.pow(1 + F.coalesce("raw", F.lit(0.0)), F.lit(2.0)))
    return own.select("query_id", "guid", "term", (F.col("s") / F.sum("s").over(doc)).alias("score"))


def combine(scores: DataFrame, how: str = "add", multiplier: float = 1.0, power: float = 1.0, least: float = 0.0, plus: float = 0.0) -> DataFrame:
    """(query_id, term, score): over the matching documents, then times, to the power of, at least, plus."""
    f = {"add": F.sum, "max": F.max, "avg": F.avg, "mul": F.product}[how]
    s = f("score")
    return scores.groupBy("query_id", "term").agg((F.greatest(F.pow(s * multiplier, F.lit(power)), F.lit(least)) + plus).alias("score"))


def best(scores: DataFrame, n: int | None) -> DataFrame:
    """The n best terms of each query with their rank, all for None; ties by the term."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "term")
    r = scores.withColumn("rank", F.row_number().over(w))
    return r if n is None else r.where(F.col("rank") <= n)


def minimal_set(scores: DataFrame, hits: DataFrame, matches: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, n_terms, rank): the shortest prefix of the terms by score whose matches rank best on average, among all documents.

    Matches without a term of a prefix don't count in its average; queries without any rank are left out. Running sums that agree in seven decimals tie.
    """
    from lectern.operators.retrieval import _weight

    own = hits.groupBy("query_id", "guid", "term").agg(F.coalesce(F.sum(F.col("qw") * F.col("fw") * _weight(weights)), F.lit(0.0)).alias("value"))

    def values(numbers: DataFrame) -> DataFrame:
        return own.where("guid is not null").join(F.broadcast(numbers), ["query_id", "term"]).select("guid", "slot", "value").repartition("guid").sortWithinPartitions("guid")

    return _minimal(best(scores, None).select("query_id", "term", F.col("rank").alias("n"), F.lit(1.0).alias("by")), matches, values, ["query_id", "term"])


def minimal_set_of(index: Index, query: DataFrame, scores: DataFrame, matches: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``minimal_set`` over all hits of the queries (query_id, term, count), which are not made."""
    from lectern.operators.retrieval import values

    ranked = best(scores, None).join(query, ["query_id", "term"], "left").select("query_id", "term", F.col("rank").alias("n"), F.coalesce(F.col("count").cast("double"), F.lit(0.0)).alias("by"))
    return _minimal(ranked, matches, lambda numbers: values(index, numbers, weights), ["term"])


def _minimal(ranked: DataFrame, matches: DataFrame, values: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """``minimal_set`` of terms in their order (query_id, term, n, by) over ``values`` (guid, slot, value) of terms numbered by ``key``, where a value counts ``by`` times.

    The running sums of the matches are sent to the documents in sorted order, in blocks of about CURVE_POINTS points. The ranks of a prefix's matches sum to
    the number of matches that each document beats there, so only these sums are exchanged.
    """
    from lectern.operators.retrieval import BLOCK_TERMS, blocks
    from lectern.plans.session import written

    spark = matches.sparkSession
    m = matches.select("query_id", "guid").distinct()
    ranked = written(ranked, "terms")
    size = ranked.groupBy("query_id").agg(F.count("*").alias("terms")).join(m.groupBy("query_id").agg(F.count("*").alias("m")), "query_id")
    n_points, n_terms = size.agg(F.sum(F.col("terms") * F.col("m")), F.sum("terms")).first()
    n = max(-(-(n_points or 0) // CURVE_POINTS), -(-(n_terms or 0) // BLOCK_TERMS))
    kind, counted = ranked.schema["query_id"].dataType.simpleString(), []
    schema = f"query_id {kind}, n int, beaten bigint, live bigint"
    for terms, own in zip(blocks(ranked.join(m.select("query_id").distinct(), "query_id", "left_semi"), n), blocks(m, n), strict=True):
        slots: dict = {}
        of: dict = {}
        for r in sorted(terms.collect(), key=lambda r: r["n"]):
            of.setdefault(r["query_id"], []).append((slots.setdefault(tuple(r[k] for k in key), len(slots)), r["by"]))
        placed = values(spark.createDataFrame([(*k, i) for k, i in slots.items()], ", ".join(f"{k} {ranked.schema[k].dataType.simpleString()}" for k in key) + ", slot long"))
        places = spark.createDataFrame([(q, i) for q, ts in of.items() for i, _ in ts], f"query_id {kind}, slot long")
        points = placed.join(own, "guid").join(F.broadcast(places), ["query_id", "slot"]).groupBy("query_id", "guid", "slot").agg(F.sum("value").alias("value")).toArrow().to_pandas()
        plan, live, curves, rows = [], [], None, None
        for q, rows in points.groupby("query_id", sort=False):
            q = q.item() if hasattr(q, "item") else q
            at, by = np.array([i for i, _ in of[q]]), np.array([x for _, x in of[q]])
            curves = _Curves(rows, at, by)
            plan.append((q, at, by, curves))
            live += [(q, k, 0, int(c)) for k, c in enumerate(np.diff(curves.starts), 1)]
        shared = spark.sparkContext.broadcast(plan)
        del plan, points, curves, rows  # the driver holds one block at a time

        def count(batches, shared=shared, n=len(slots)):  # noqa: ANN001, ANN202
            from lectern.operators.retrieval import tables

            totals = [np.zeros(len(at), np.int64) for _, at, _, _ in shared.value]
            for guids, table in tables(batches, n):
                for (_, at, by, curves), total in zip(shared.value, totals, strict=True):
                    curves.beaten(guids, np.cumsum(table[at] * by[:, None], axis=0), total)
            for (q, *_), total in zip(shared.value, totals, strict=True):
                yield pd.DataFrame({"query_id": [q] * len(total), "n": np.arange(1, len(total) + 1, dtype=np.int32), "beaten": total, "live": np.zeros(len(total), np.int64)})

        counted.append(written(placed.mapInPandas(count, schema).unionByName(spark.createDataFrame(live, schema)), "beaten"))
        shared.destroy()
    per = reduce(DataFrame.unionByName, counted).groupBy("query_id", "n").agg(F.sum("beaten").alias("beaten"), F.sum("live").alias("live")).where("live > 0")
    per = per.withColumn("rank", (F.col("beaten") + F.col("live")) / F.col("live"))
    return per.groupBy("query_id").agg(F.min(F.struct(F.round("rank", 9), "n", "rank")).alias("b")).select("query_id", F.col("b.n").alias("n_terms"), F.col("b.rank").alias("rank"))


class _Curves:
    """The running sums of a query's matches in sevenths of decimals: those above 0, sorted within each prefix, with their guids' places for ties."""

    def __init__(self, rows: pd.DataFrame, slots: np.ndarray, by: np.ndarray) -> None:
        at, guids = pd.factorize(rows["guid"], sort=True)
        self.guids = np.asarray(guids)
        table = np.zeros((len(slots), len(guids)))
        order = np.argsort(slots)
        table[order[np.searchsorted(slots[order], rows["slot"].to_numpy())], at] = rows["value"].to_numpy()
        sums = self.whole(np.cumsum(table * by[:, None], axis=0))
        place = np.argsort(sums, axis=1, kind="stable")
        sums = np.take_along_axis(sums, place, axis=1)
        live = sums > 0
        self.step = int(sums.max(initial=0)) + 2
        self.starts = np.append(0, np.cumsum(live.sum(axis=1)))
        self.keys = (sums + self.step * np.arange(len(slots))[:, None])[live]
        self.places = place[live].astype(np.int32)
        self.low = np.where(live, sums / 1e7 - 1e-7, np.inf).min(axis=1, initial=np.inf)

    @staticmethod
    def whole(sums: np.ndarray) -> np.ndarray:
        return np.rint(sums * 1e7).astype(np.int64)

    def beaten(self, guids: np.ndarray, sums: np.ndarray, total: np.ndarray) -> None:
        """Add to ``total`` how many matches these documents rank before at each prefix, by ``sums`` (prefixes by documents)."""
        n, doc = np.nonzero(sums > self.low[:, None])
        if not len(n):
            return
        key = n * self.step + np.minimum(self.whole(sums[n, doc]), self.step - 1)
        lo = np.searchsorted(self.keys, key)
        got = lo - self.starts[n]
        tied = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == key)
        if len(tied):
            # Of equal sums, those of greater guids come after the document; places ascend among them.
            a, hi = lo[tied], np.searchsorted(self.keys, key[tied], "right")
            z, own = hi.copy(), np.searchsorted(self.guids, guids, "right")[doc[tied]]
            while (open_ := a < z).any():
                mid = np.minimum((a + z) // 2, len(self.places) - 1)
                less = self.places[mid] < own
                a, z = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, z)
            got[tied] += hi - a
        total += np.bincount(n, got, len(total)).astype(np.int64)


def add_and_drop(hits: DataFrame, matches: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, term): a greedy set for each query - terms added by score while the mean rank of the matches improves, then each
    dropped from the lowest if the rank stays at least as good. Each query's hits are worked on alone."""
    data = hits.groupBy("query_id", "guid", "term").agg(F.sum(F.col("qw") * F.col("fw")).alias("s"))
    data = data.join(matches.select("query_id", "guid").distinct().withColumn("m", F.lit(True)), ["query_id", "guid"], "left").join(scores.select("query_id", "term", "score"), ["query_id", "term"])

    def choose(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        table = pdf.pivot_table(index="guid", columns="term", values="s", fill_value=0.0).sort_index()
        good = pdf.loc[pdf["m"].eq(True), "guid"].unique()
        order = pdf.drop_duplicates("term").sort_values(["score", "term"], ascending=[False, True])["term"].tolist()

        def rank(terms: list[str]) -> float:
            if not terms or not len(good):
                return 200.0
            s = table[terms].sum(axis=1)
            place = s.rank(method="first", ascending=False)
            return float(sum(place[g] if s[g] > 0 else 200.0 for g in good) / len(good))

        chosen: list[str] = []
        at = 200.0
        for t in order:
            if (r := rank([*chosen, t])) < at:
                chosen, at = [*chosen, t], r
        for t in chosen[::-1]:
            rest = [x for x in chosen if x != t]
            if rest and (r := rank(rest)) <= at:
                chosen, at = rest, r
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(chosen), "term": chosen})

    return data.groupBy("query_id").applyInPandas(choose, f"query_id {hits.schema['query_id'].dataType.simpleString()}, term string")


def shares(scores: DataFrame, terms: list[str]) -> DataFrame:
    """(query_id, share): what part of each query's score the given terms make."""
    own = F.sum(F.when(F.col("term").isin(terms), F.col("score")).otherwise(0.0))
    return scores.groupBy("query_id").agg(F.try_divide(own, F.sum("score")).alias("share"))


def baseline_weight(df: Column, most_df: Column) -> Column:
    """(1 + ln(max_df / df))^2"""
    return F.pow(1 + F.ln(most_df / df), F.lit(2.0))


def bins(weight: Column, edges: tuple[float, ...] = (0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.2, 0.3, 0.4)) -> Column:
    """The number of the last edge below the weight; the last bin has no upper end."""
    return reduce(lambda c, i: F.when(weight > edges[i], i).otherwise(c), range(len(edges)), F.lit(-1))


def _q():  # noqa: ANN202
    return Window.partitionBy("query_id")


def _scaled(c: Column) -> Column:
    return c / F.max("__w").over(_q())


def _extremes(low: int, high: int, by_low: float, by_high: float) -> Column:
    up = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "term"))
    down = F.row_number().over(Window.partitionBy("query_id").orderBy("weight", F.desc("term")))
    return F.when(up <= high, F.col("weight") * by_high).when(down <= low, F.col("weight") * by_low).otherwise(F.col("weight"))


#: Weight transforms by name; each gives the new weight of (query_id, term, weight) rows.
TRANSFORMS: dict[str, Callable[..., Column]] = {
    "multiply": lambda by=2.0: F.col("weight") * by,
    "add": lambda by=1.0: F.col("weight") + by,
    "constant": lambda to=1.0: F.lit(float(to)),
    "random": lambda seed=1: F.rand(seed),
    "add_random": lambda seed=1: F.col("weight") + F.rand(seed),
    "top": lambda k=3, by=1.1: _extremes(0, k, 1.0, by),
    "bottom": lambda k=3, by=10.0: _extremes(k, 0, by, 1.0),
    "extremes": lambda high=3, by_high=2.0, low=3, by_low=0.5: _extremes(low, high, by_low, by_high),
    "invert": lambda by=1.0: F.try_divide(F.lit(by), F.col("weight")),
    "raise_low": lambda part=1.0: F.when(F.col("weight") < F.max("weight").over(_q()) / F.count("*").over(_q()) * part, F.col("weight") * 10).otherwise(F.col("weight")),
    "by_max": lambda: F.col("weight") / F.max("weight").over(_q()),
    "sigmoid": lambda: sigmoid(F.col("weight") / F.max("weight").over(_q())),
    "power": lambda p=2.0: F.pow("weight", F.lit(p)),
    "over_sigmoid": lambda p=1.0: F.col("weight") / F.pow(sigmoid("weight"), F.lit(p)),
    "quadratic": lambda p=1.0: F.col("weight") * (1 + F.pow(F.pow(F.col("weight") / F.max("weight").over(_q()) - F.max("weight").over(_q()) / 2, F.lit(2.0)), F.lit(p))),
    "tanh": lambda: F.col("weight") * F.tanh("weight"),
}
#: Transforms whose result is divided by the query's largest.
SCALED = {"over_sigmoid", "quadratic", "tanh"}


def transform(weights: DataFrame, name: str, **args: float) -> DataFrame:
    out = weights.withColumn("__w", TRANSFORMS[name](**args))
    return out.withColumn("weight", _scaled(F.col("__w")) if name in SCALED else F.col("__w")).drop("__w")


def transform_all(weights: DataFrame, names: list[str]) -> DataFrame:
    """(query_id, term, a column for each transform): all over one window of each query."""
    out = weights
    for n in names:
        out = out.withColumn("__w", TRANSFORMS[n]())
        out = out.withColumn(n, _scaled(F.col("__w")) if n in SCALED else F.col("__w"))
    return out.select("query_id", "term", *names)


def compare_transforms(index: Index, query: DataFrame, weights: DataFrame, matches: DataFrame, near: DataFrame, fields: dict[str, float], names: list[str]) -> DataFrame:
    """(transform, n_queries, ndcg): mean NDCG of each transform of the keyword weights over all hits of the queries (query_id, term, count). Scores that agree in nine decimals of their logarithm tie.

    ``near``: query_id, guid of documents that are likely to score high; the TOP-th best of them is where the search for the TOP best of all documents starts.
    """
    from lectern.operators.metrics import measure
    from lectern.operators.retrieval import TOP, _weight, best_by, formula_hits, top
    from lectern.plans.session import written

    w = written(transform_all(weights, names).join(query.select("query_id", "term", "count"), ["query_id", "term"]), "weights")
    few = w.select("query_id", "term", F.lit(1).alias("count"))
    leaf = formula_hits(index, few, pairs=near.join(w.select("query_id").distinct(), "query_id", "left_semi")).join(w, ["query_id", "term"])
    leaf = leaf.withColumn("__s", F.col("qw") * F.col("fw") * F.col("count") * _weight(fields))
    sums = leaf.groupBy("query_id", "guid").agg(*[F.sum(F.col("__s") * F.col(f"`{n}`")).alias(n) for n in names])
    floors = {r[0]: list(r[1:]) for r in sums.groupBy("query_id").agg(*[F.get(F.sort_array(F.collect_list(n), asc=False), F.lit(TOP - 1)).alias(n) for n in names]).collect()}
    ranked = best_by(index, w.select("query_id", "term", *[(F.col("count") * F.col(f"`{n}`")).alias(n) for n in names]), fields, names, log=True, floors=floors)
    key = F.struct(F.col("kind").alias("transform"), F.col("query_id").alias("q")).alias("query_id")
    ranked = top(ranked.select(key, "guid", "score"))
    of = matches.withColumn("transform", F.explode(F.array(*map(F.lit, names)))).select(F.struct("transform", F.col("query_id").alias("q")).alias("query_id"), "guid")
    return measure(ranked, of).groupBy("query_id.transform").agg(F.count("*").alias("n_queries"), F.avg("ndcg").alias("ndcg"))


def ngrams(docs: DataFrame, key: str, words: Column, n: int, least: int, stopwords: list[str]) -> DataFrame:
    """(key, ngram, n): runs of n words without stopwords that a document has at least ``least`` times."""
    w = F.col("w")
    runs = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.slice(w, i + 1, n))).otherwise(F.array().cast("array<array<string>>"))
    clean = F.filter(runs, lambda r: ~F.arrays_overlap(r, F.array(*map(F.lit, stopwords))))
    out = docs.select(key, words.alias("w")).where("w is not null").select(key, F.explode(clean).alias("r"))
    return out.groupBy(key, F.array_join("r", " ").alias("ngram")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def corpus_stopwords(terms: DataFrame, part: float = 0.4) -> DataFrame:
    """Terms of 2 to 6 letters in at least a part of the documents of the most frequent one."""
    top_df = terms.agg(F.max("df").alias("most"))
    return terms.where((F.col("df") >= part * top_df.scalar()) & F.length("term").between(2, 6)).select("field", "term", "df")


def divisor_sweep(terms: DataFrame, gold: DataFrame, divisors: list[float]) -> DataFrame:
    """(divisor, f1): how well the terms rarer than max df / divisor agree with the gold terms (one term column), for each divisor."""
    most = terms.agg(F.max("df").alias("most"))
    t = terms.select("term", "df").join(gold.select("term").distinct().withColumn("gold", F.lit(1)), "term", "left")
    t = t.withColumn("most", most.scalar()).withColumn("divisor", F.explode(F.array(*[F.lit(float(x)) for x in divisors])))
    pred = F.col("df") <= F.col("most") / F.col("divisor")
    n = t.groupBy("divisor").agg(F.sum((pred & F.col("gold").isNotNull()).cast("int")).alias("tp"), F.sum(pred.cast("int")).alias("p"), F.count("gold").alias("g"))
    return n.select("divisor", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("p") + F.col("g")), F.lit(0.0)).alias("f1"))
