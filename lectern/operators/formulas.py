"""Explanations of scores as leaves, stored for the retrieved documents, and what is computed from them under new weights."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import metrics, retrieval

LEAF = "field string, term string, qw double, fw double, tf bigint, doc_freq bigint, max_docs bigint"
_WEIGHT = re.compile(r"weight\((?P<field>[^:()]+):(?P<term>.*?)\s+in\s", re.I)
_COUNTS = re.compile(r"docFreq=(\d+),\s*maxDocs=(\d+)", re.I)
_FREQ = re.compile(r"\bfreq=([\d.]+)", re.I)


def leaves(node: dict) -> tuple[float, list[dict]]:
    """(coordination factor, leaves) of an explanation tree of value, description and details.

    A leaf is a node whose description weighs a term in a field; query and field weight are read from what is below it, the query weight being 1 where
    only the field's is reported. Sums, products and maxima above are passed through.
    """
    text, below = node.get("description", ""), node.get("details", [])
    if text.startswith("coord"):
        return float(node["value"]), []
    if m := _WEIGHT.match(text):
        leaf = {"field": m["field"], "term": m["term"], "qw": 1.0, "fw": float(node.get("value", 0.0)), "tf": None, "doc_freq": None, "max_docs": None}
        todo = list(below)
        while todo:
            n = todo.pop(0)
            d = n.get("description", "")
            if d.startswith("queryWeight"):
                leaf["qw"] = float(n["value"])
            elif d.startswith("fieldWeight"):
                leaf["fw"] = float(n["value"])
            if leaf["doc_freq"] is None and (c := _COUNTS.search(d)):
                leaf["doc_freq"], leaf["max_docs"] = int(c[1]), int(c[2])
            if leaf["tf"] is None and d.startswith("tf(") and (c := _FREQ.search(d)):
                leaf["tf"] = int(float(c[1]))
            todo += n.get("details", [])
        return 1.0, [leaf]
    factor, out = 1.0, []
    for n in below:
        f, own = leaves(n)
        factor, out = factor * f, out + own
    return factor, out


def outline(text: str) -> dict:
    """The tree of an explanation written as lines ``value = description``, each level two blanks further in."""
    root: dict = {"value": 0.0, "description": "", "details": []}
    stack = [(-1, root)]
    for line in text.splitlines():
        if m := re.match(r"(\s*)([-+.\dEe]+)\s*=\s*(?:\(MATCH\)\s*)?(.*)", line):
            level, node = len(m[1]), {"value": float(m[2]), "description": m[3].strip(), "details": []}
            while stack[-1][0] >= level:
                stack.pop()
            stack[-1][1]["details"].append(node)
            stack.append((level, node))
    return root["details"][0] if len(root["details"]) == 1 else root


def parse_explanations(rows: DataFrame, query: str = "query_id", guid: str = "guid", explanation: str = "explanation") -> DataFrame:
    """(query_id, guid, coord, leaf fields): of explanations as JSON trees or outlines. Null and unreadable ones have no rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, g, e in zip(b[query], b[guid], b[explanation], strict=True):
                if not e:
                    continue
                try:
                    tree = json.loads(e)
                    tree = tree.get("explanation", tree)
                except (ValueError, AttributeError):
                    tree = outline(e)
                coord, own = leaves(tree)
                out += [(q, g, coord, *x.values()) for x in own]
            yield pd.DataFrame(out, columns=["query_id", "guid", "coord", "field", "term", "qw", "fw", "tf", "doc_freq", "max_docs"]).astype({"tf": "Int64", "doc_freq": "Int64", "max_docs": "Int64"})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (query, guid)}
    return rows.select(query, guid, explanation).mapInPandas(read, f"query_id {kinds[query]}, guid {kinds[guid]}, coord double, {LEAF}")


def stored(index: retrieval.Index, query: DataFrame, weights: dict[str, float], matches: DataFrame | None = None, k: int = retrieval.TOP) -> DataFrame:
    """The leaves of the k best documents of each query, and of its matches: all that is needed to rank them anew."""
    best = retrieval.top(retrieval.score(retrieval.formula_hits(index, query), weights).withColumn("score", F.round("score", 9)), k).select("query_id", "guid")
    return retrieval.formula_hits(index, query, pairs=best if matches is None else best.union(matches.select("query_id", "guid")))


def write_by_class(hits: DataFrame, classes: DataFrame, path: str) -> None:
    """Stored leaves beside the class (query_id, class) of their query, a folder a class."""
    hits.join(classes, "query_id").write.mode("overwrite").partitionBy("class").parquet(path)


def exhaustive(index: retrieval.Index, query: DataFrame, docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, guid, score) of every document for every query, 0 where nothing is shared: the check of a ranked run, for few queries."""
    got = retrieval.score(retrieval.formula_hits(index, query), weights)
    ids = [r[0] for r in query.select("query_id").distinct().limit(101).collect()]
    if len(ids) > 100:
        raise ValueError("more than 100 queries")
    kind = query.schema["query_id"].dataType
    grid = docs.select("guid", F.explode(F.array(*[F.lit(i).cast(kind) for i in ids]).cast(f"array<{kind.simpleString()}>")).alias("query_id"))
    return grid.join(got, ["query_id", "guid"], "left").select("query_id", "guid", F.coalesce("score", F.lit(0.0)).alias("score"))


def boosted(hits: DataFrame, boosts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores with a boost for a query's term in a field (query_id, field, term, boost), 1 where there is none."""
    j = hits.join(boosts, ["query_id", "field", "term"], "left").withColumn("qw", F.col("qw") * F.coalesce("boost", F.lit(1.0)))
    return retrieval.score(j, weights)


def phrase_hits(docs: DataFrame, key: str, field: str, phrases: DataFrame) -> DataFrame:
    """(query_id, guid, phrase, tf): how often a document has a query's phrase (query_id, phrase), found as runs of words; joins by run, no pairs of documents and queries."""
    p = phrases.select("query_id", "phrase", F.array_join(X.tokens("phrase"), " ").alias("run"), F.size(X.tokens("phrase")).alias("n")).where("n > 1")
    sizes = [r["n"] for r in p.select("n").distinct().where("n <= 8").collect()]
    w = docs.select(F.col(key).alias("guid"), X.tokens(field).alias("w"))
    out = None
    for n in sorted(sizes):
        runs = F.expr(f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n - 1}), i -> array_join(slice(w, i, {n}), ' ')) END")
        part = w.select("guid", F.explode(runs).alias("run")).join(p.where(F.col("n") == n), "run").groupBy("query_id", "guid", "phrase").agg(F.count("*").alias("tf"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else phrases.select("query_id", F.lit(None).cast("string").alias("guid"), "phrase", F.lit(0).cast("bigint").alias("tf")).limit(0)


def values_by_term(hits: DataFrame) -> DataFrame:
    """(query_id, term, n_docs, least, mean, most): what a term scores over the documents of a query, and in how many it is."""
    per = hits.groupBy("query_id", "guid", "term").agg(F.max(F.col("qw") * F.col("fw")).alias("s"))
    return per.groupBy("query_id", "term").agg(F.count("*").alias("n_docs"), F.min("s").alias("least"), F.avg("s").alias("mean"), F.max("s").alias("most"))


def phrase_counts(queries: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """(query_id, phrase, count): how often a query's phrase stands in its text, whatever is between its words."""
    j = phrases.select("query_id", "phrase").distinct().join(queries.select("query_id", F.col(text).alias("__t")), "query_id")
    pattern = F.array_join(F.transform(F.split("phrase", " "), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1")), r"[^\p{L}\p{N}_]+")
    return j.select("query_id", "phrase", F.regexp_count("__t", pattern).cast("bigint").alias("count"))


def phrase_scores(terms: DataFrame, phrases: DataFrame, how: str = "add", multiplier: float = 1.0, constant: float = 1.0) -> DataFrame:
    """(query_id, phrase, score): the sum, mean or a constant of the scores of a phrase's words, all of which must be among the terms (query_id, term, score)."""
    words = phrases.select("query_id", "phrase", F.split("phrase", " ").alias("w")).withColumn("term", F.explode("w"))
    got = words.join(terms.select("query_id", "term", "score"), ["query_id", "term"]).groupBy("query_id", "phrase", F.size("w").alias("n")).agg(F.sum("score").alias("s"), F.count("*").alias("k")).where("k = n")
    value = {"add": F.col("s"), "avg": F.col("s") / F.col("n"), "const": F.lit(float(constant))}[how]
    return got.select("query_id", "phrase", (value * multiplier).alias("score"))


def with_phrases(terms: DataFrame, phrases: DataFrame, method: str = "add") -> DataFrame:
    """(query_id, term, score): terms beside the phrases (query_id, phrase, score), or without the words that phrases stand for (``sub``)."""
    add = phrases.select("query_id", F.col("phrase").alias("term"), "score")
    if method == "sub":
        used = phrases.select("query_id", F.explode(F.split("phrase", " ")).alias("term")).distinct()
        return terms.select("query_id", "term", "score").join(used, ["query_id", "term"], "left_anti").unionByName(add)
    if method != "add":
        raise ValueError(f"no such method: {method}")
    return terms.select("query_id", "term", "score").unionByName(add)


def present_phrases(docs: DataFrame, key: str, words: Column, phrases: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(key, phrase): the phrases of a list (phrase) that stand in a text; a semi join on runs of words."""
    w = docs.select(key, words.alias("w"))
    runs = F.flatten(F.array(*[F.expr(f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n - 1}), i -> array_join(slice(w, i, {n}), ' ')) ELSE array() END") for n in sizes]))
    return w.select(key, F.explode(F.array_distinct(runs)).alias("phrase")).join(phrases.select("phrase").distinct(), "phrase", "left_semi").select(key, "phrase")


def joined_phrases(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, phrase, n): numbers of two lists summed."""
    return a.select(key, "phrase", "n").unionByName(b.select(key, "phrase", "n")).groupBy(key, "phrase").agg(F.sum("n").alias("n"))


def common_phrases(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, phrase) of both lists."""
    return a.select(key, "phrase").intersect(b.select(key, "phrase"))


def query_words(queries: DataFrame, text: str, scores: DataFrame, weighted: bool = True) -> DataFrame:
    """(query_id, term, score): all words of a query with their score among the matches, 0 where they have none, or 1 for all."""
    words = queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.regexp_replace(text, "__(?:cit|author)", " ")))).alias("term"))
    if not weighted:
        return words.withColumn("score", F.lit(1.0))
    return words.join(scores.select("query_id", "term", "score"), ["query_id", "term"], "left").select("query_id", "term", F.coalesce("score", F.lit(0.0)).alias("score"))


def annotate_tokens(tokens: DataFrame, keywords: DataFrame, ctx: str = "query_id") -> DataFrame:
    """Tokens (ctx, pos, token) with extract, whether they are keywords (ctx, term, score) of their context, and the weight, 0 for others."""
    k = keywords.select(ctx, F.col("term").alias("token"), F.col("score").alias("weight"))
    return tokens.join(k, [ctx, "token"], "left").withColumn("extract", F.col("weight").isNotNull()).withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def gold_weights(tokens: DataFrame, gold: DataFrame, stopwords: list[str], ctx: str = "query_id") -> DataFrame:
    """Baseline: every token that is no stopword with its gold weight (ctx, term, weight), 0 without one."""
    own = tokens.where(~F.col("token").isin(stopwords)).select(ctx, F.col("token").alias("term")).distinct()
    return own.join(gold.select(ctx, "term", "weight"), [ctx, "term"], "left").na.fill(0.0, ["weight"])


def gold_only(tokens: DataFrame, gold: DataFrame, ctx: str = "query_id") -> DataFrame:
    """Oracle: exactly the gold keywords that stand in the context."""
    return gold.join(tokens.select(ctx, F.col("token").alias("term")).distinct(), [ctx, "term"], "left_semi")


def prediction_stats(texts: DataFrame, predicted: DataFrame, text: str, stopwords: list[str]) -> DataFrame:
    """One row: keywords predicted (query_id, term), how often they stand in their texts, all words, and the ratio of the two."""
    words = texts.select("query_id", F.explode(X.tokens(F.regexp_replace(text, "__(?:cit|author|ref)|#stop#", " "))).alias("term"))
    terms = predicted.select("query_id", F.lower("term").alias("term")).where((F.length("term") > 1) & ~F.col("term").isin(stopwords)).distinct()
    own = words.groupBy("query_id", "term").agg(F.count("*").alias("n"))
    hit = own.join(terms.withColumn("k", F.lit(1)), ["query_id", "term"], "left")
    n = hit.agg(F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("n_extracted"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"))
    return n.withColumn("n_unique", terms.agg(F.count("*")).scalar()).select("n_unique", "n_extracted", "n_words", F.coalesce(F.try_divide("n_extracted", "n_words"), F.lit(0.0)).alias("ratio"))


def extra_weights(weights: dict[str, float] | list[str], extra: dict[str, float]) -> dict[str, float]:
    """Field weights, all 1 for a list of fields, with fixed ones beside them."""
    return (dict.fromkeys(weights, 1.0) if isinstance(weights, list) else dict(weights)) | extra


def preset_scores(hits: DataFrame, classes: DataFrame, presets: DataFrame) -> DataFrame:
    """Scores under the field weights (query_class, field, weight) of each query's class: the first of its classes (query_id, az, csc_type) that has presets.

    Queries without a preset class have no rows; fields without a weight count nothing.
    """
    known = presets.select("query_class").distinct()
    az = classes.select("query_id", F.col("az").alias("query_class"), F.lit(0).alias("o")).unionByName(classes.select("query_id", F.col("csc_type").alias("query_class"), F.lit(1).alias("o")))
    cls = az.join(known, "query_class").groupBy("query_id").agg(F.min_by("query_class", "o").alias("query_class"))
    leaf = hits.join(cls, "query_id").join(presets, ["query_class", "field"])
    return leaf.groupBy("query_id", "guid").agg(F.sum(F.col("qw") * F.col("fw") * F.col("weight")).alias("score")).where("score > 0")


def weights_value(hits: DataFrame, matches: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: the mean metrics of stored leaves under a weight vector."""
    m = metrics.measure(retrieval.top(retrieval.score(hits, weights).withColumn("score", F.round("score", 9))), matches)
    return m.agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in ("mrr", "precision", "ndcg", "map")])


def held_out(hits: DataFrame, matches: DataFrame, folds: DataFrame, fields: list[str], k: int, train: Callable[..., tuple[dict[str, float], float]], metric: str = "ndcg") -> DataFrame:
    """(fold, field weights as JSON, baseline, trained, improvement in per cent): weights trained on the other folds (query_id, fold), measured on each."""
    rows = []
    for f in range(k):
        own, rest = folds.where(F.col("fold") == f).select("query_id"), folds.where(F.col("fold") != f).select("query_id")
        part = lambda df, ids: df.join(ids, "query_id", "left_semi")
        w, _ = train(part(hits, rest), part(matches, rest), fields, metric=metric)
        value = lambda weights, own=own: weights_value(part(hits, own), part(matches, own), weights).first()[metric] or 0.0
        base, got = value(dict.fromkeys(fields, 1.0)), value(w)
        rows.append((f, json.dumps(w, sort_keys=True), base, got, 100.0 * (got - base) / base if base else 0.0))
    return hits.sparkSession.createDataFrame(rows, "fold int, weights string, baseline double, trained double, improvement double")


#: Keyword selectors by name: (scores of terms, number) -> terms with rank. Own ones can be added.
SELECTORS: dict[str, Callable[..., DataFrame]] = {}


def _selectors() -> None:
    from lectern.operators import keywords as K

    SELECTORS.update({"all": lambda s, **_: K.best(s, None), "n_best": lambda s, n=10, **_: K.best(s, n), "at_least": lambda s, least=0.0, **_: K.best(s.where(F.col("score") >= least), None)})


_selectors()


def compare_selectors(scores: DataFrame, hits: DataFrame, matches: DataFrame, weights: dict[str, float], selectors: dict[str, dict]) -> DataFrame:
    """(selector, weighted, n_queries, n_terms, mrr, ndcg): stored leaves ranked anew by the terms each selector (name -> arguments) chooses, plain and weighted by score."""
    out = None
    for name, args in selectors.items():
        chosen = SELECTORS[args.get("selector", name)](scores, **{k: v for k, v in args.items() if k != "selector"})
        for weighted in (False, True):
            kw = chosen.select("query_id", "term", (F.col("score") if weighted else F.lit(1.0)).alias("weight"))
            ranked = retrieval.top(retrieval.score_keywords(hits, weights, kw).withColumn("score", F.round(F.ln("score"), 9)))
            m = metrics.measure(ranked, matches).agg(F.count("*").alias("n_queries"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"))
            row = m.withColumn("n_terms", chosen.agg(F.count("*")).scalar()).select(F.lit(name).alias("selector"), F.lit(weighted).alias("weighted"), "n_queries", "n_terms", "mrr", "ndcg")
            out = row if out is None else out.unionByName(row)
    return out


def of_year(docs: DataFrame, papers: DataFrame, most: int) -> DataFrame:
    """Documents of papers (guid, year) up to a year: what an index of that time may hold. Papers without a year are left out."""
    return docs.join(papers.where(F.col("year") <= most).select("guid").distinct(), "guid", "left_semi")


def fields_to_index(columns: list[str], own: list[str] | None = None) -> list[str]:
    """The text fields of a representation: those named, or all but ids and metadata."""
    return [c for c in columns if (c in own if own else not c.startswith(("_", "metadata")) and c not in ("guid", "year", "collection_id"))]
