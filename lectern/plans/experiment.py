"""Experiments: a declarative dict becomes one plan from documents to averaged metrics.

Names in the dict are looked up in registries, so that own builders can be added: representation builders (method name -> columns), query
extractors and scorers.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import documents as D
from lectern.operators import metrics, retrieval


def _passages(docs: DataFrame, size: int) -> DataFrame:
    return D.passages(docs, "guid", "text", size).select(F.concat_ws("#", "guid", "offset").alias("guid"), F.col("passage").alias("text"))


#: Builders of representations: (docs with guid and text, parameter) -> docs with guid and text.
BUILDERS: dict[str, Callable[[DataFrame, object], DataFrame]] = {
    "full_text": lambda docs, _: docs.select("guid", "text"),
    "head": lambda docs, n: docs.select("guid", F.substring("text", 1, int(n)).alias("text")),
    "passage": lambda docs, n: _passages(docs, int(n)),
}
#: Extractors of query text: (text column, parameter) -> column.
EXTRACTORS: dict[str, Callable[[Column, object], Column]] = {
    "whole": lambda t, _: t,
    "window": lambda t, n: F.array_join(F.slice(X.tokens(t), 1, int(n)), " "),
}
SCORERS: dict[str, Callable[[DataFrame, dict[str, float]], DataFrame]] = {
    "sum": retrieval.score, "best_field": lambda h, w: retrieval.score_best_field(h, w, 0.0), "mean_field": lambda h, w: retrieval.score_best_field(h, w, 1.0),
}


@dataclass(frozen=True)
class Method:
    kind: str
    parameter: object

    @property
    def name(self) -> str:
        return self.kind if self.parameter is None else f"{self.kind}_{self.parameter}"


def expand(methods: dict[str, dict]) -> list[Method]:
    """Every method with each of its parameters; two lists of parameters are crossed."""
    out = []
    for kind, spec in methods.items():
        lists = [spec.get("parameters") or [None]] + ([spec["inner_parameters"]] if spec.get("inner_parameters") else [])
        for p in itertools.product(*lists):
            out.append(Method(kind, p[0] if len(p) == 1 else "_".join(map(str, p))))
    return out


def missing(wanted: list[Method], built: DataFrame) -> list[Method]:
    """Methods without rows in a table of built representations (method)."""
    there = {r["method"] for r in built.select("method").distinct().collect()}
    return [m for m in wanted if m.name not in there]


def run(config: dict, docs: DataFrame, queries: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_method, query_method, scorer, n_queries, averages of the metrics).

    ``docs``: guid, text; ``queries``: query_id, text; ``matches``: query_id, guid. config: doc_methods and query_methods by name with parameters, scorers,
    max_results. A query that retrieves nothing scores 0. Passages of a document count by their best.
    """
    rows = None
    k = int(config.get("max_results", retrieval.TOP))
    for dm in expand(config["doc_methods"]):
        index = retrieval.build(BUILDERS[dm.kind](docs, dm.parameter), "guid", ["text"])
        for qm in expand(config["query_methods"]):
            q = queries.select("query_id", EXTRACTORS[qm.kind](F.col("text"), qm.parameter).alias("text"))
            hits = retrieval.formula_hits(index, retrieval.structured_query(q, "query_id", "text"))
            for scorer in config.get("scorers", ["sum"]):
                scores = SCORERS[scorer](hits, {"text": 1.0}).withColumn("guid", F.split_part("guid", F.lit("#"), F.lit(1))).groupBy("query_id", "guid").agg(F.round(F.max("score"), 9).alias("score"))
                m = metrics.with_empty(metrics.measure(retrieval.top(scores, k), matches), matches.select("query_id"))
                m = m.withColumns({"doc_method": F.lit(dm.name), "query_method": F.lit(qm.name), "scorer": F.lit(scorer)})
                rows = m if rows is None else rows.unionByName(m)
    return metrics.averages(rows, ["doc_method", "query_method", "scorer"])


def recommend(index: retrieval.Index, text: str, weights: dict[str, float], left: int = 20, right: int = 20, k: int = 10) -> DataFrame:
    """The k best documents for the words around ``<insert_citation>`` in a text."""
    spark = index.postings.sparkSession
    before, _, after = text.partition("<insert_citation>")
    t = spark.createDataFrame([(0, before, after)], "query_id int, b string, a string")
    w = lambda c: X.tokens(c)
    q = t.select("query_id", F.array_join(F.concat(F.slice(w("b"), F.greatest(F.size(w("b")) - left + 1, F.lit(1)), left), F.slice(w("a"), 1, right)), " ").alias("text"))
    return retrieval.top(retrieval.score(retrieval.formula_hits(index, retrieval.structured_query(q, "query_id", "text")), weights), k).drop("query_id")
