"""Term filters, overlaps of documents in terms, keyphrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.keywords import ngrams


def filter_terms(terms: DataFrame, min_df: int = 0, max_df: int | None = None, min_length: int = 1, stopwords: list[str] | None = None) -> DataFrame:
    """Terms (term, df) within the bounds; a null df counts as 0."""
    df = F.coalesce("df", F.lit(0))
    ok = (df >= min_df) & (F.length("term") >= min_length) & ~F.col("term").isin(stopwords or [])
    return terms.where(ok & (df <= max_df if max_df is not None else F.lit(True)))


def shared_terms(postings: DataFrame, links: DataFrame, most_share: float | None = None) -> DataFrame:
    """(guid, to, n_shared): numbers of terms of a paper that a paper it cites has too. Terms shared with more than a share of its references are dropped.

    ``postings``: guid, term; ``links``: guid, to.
    """
    own = postings.select("guid", "term").distinct()
    there = own.select(F.col("guid").alias("to"), "term")
    pairs = links.select("guid", "to").distinct().join(own, "guid").join(there, ["to", "term"])
    if most_share is not None:
        n = links.select("guid", "to").distinct().groupBy("guid").agg(F.count("*").alias("refs"))
        common = pairs.groupBy("guid", "term").agg(F.count("*").alias("k")).join(n, "guid").where(F.col("k") > most_share * F.col("refs")).select("guid", "term")
        pairs = pairs.join(common, ["guid", "term"], "left_anti")
    return pairs.groupBy("guid", "to").agg(F.count("*").alias("n_shared"))


def document_keyphrases(docs: DataFrame, key: str, title: str, abstract: str, body: str, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(key, ngram, n): runs of words without stopwords, at least once in title or abstract or twice in the body; numbers summed."""
    out = None
    for field, least in ((title, 1), (abstract, 1), (body, 2)):
        for n in sizes:
            part = ngrams(docs, key, X.tokens(field), n, least, X.STOPWORDS)
            out = part if out is None else out.unionByName(part)
    return out.groupBy(key, "ngram").agg(F.sum("n").alias("n"))


def text_rank(docs: DataFrame, key: str, text: str, rounds: int = 10, damping: float = 0.85, window: int = 2) -> DataFrame:
    """(key, term, score): PageRank of a document's words over pairs at most ``window`` - 1 apart; a fixed number of rounds, one join each."""
    t = docs.select(key, F.posexplode(X.without_stopwords(X.tokens(text))).alias("pos", "term"))
    w = Window.partitionBy(key).orderBy("pos")
    pairs = None
    for d in range(1, window):
        p = t.select(key, F.col("term").alias("a"), F.lead("term", d).over(w).alias("b")).where("b is not null and a <> b")
        pairs = p if pairs is None else pairs.unionByName(p)
    edges = pairs.unionByName(pairs.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    out = edges.groupBy(key, "a").agg(F.count("*").alias("out"))
    scores = out.select(key, F.col("a").alias("term"), F.lit(1.0).alias("score"))
    links = edges.join(out, [key, "a"])
    for _ in range(rounds):
        got = links.join(scores.withColumnRenamed("term", "a"), [key, "a"]).groupBy(key, F.col("b").alias("term")).agg(F.sum(F.col("score") / F.col("out")).alias("s"))
        scores = got.select(key, "term", ((1 - damping) + damping * F.col("s")).alias("score"))
    return scores


def author_overlap_matches(refs: DataFrame, papers: DataFrame, least: float = 0.95) -> DataFrame:
    """(ref_id, guid): papers of the same year of whose surnames at least a share occur in the reference's authors. Blocked by year and surname."""
    a = refs.where("year is not null").select("ref_id", "year", "names", F.explode(F.array_distinct("names")).alias("block"))
    b = papers.where("year is not null and size(surnames) > 0").select("guid", "year", "surnames", F.explode(F.array_distinct("surnames")).alias("block"))
    j = a.join(b, ["year", "block"]).select("ref_id", "guid", "names", "surnames").distinct()
    return j.where(X.author_overlap(F.col("surnames"), F.col("names")) >= least).select("ref_id", "guid")


def merge_after_et_al(sentences: DataFrame, doc: str = "doc", ord: str = "ord") -> DataFrame:
    """(doc, ord, text): a sentence that ends in et al. takes the next one in."""
    w = Window.partitionBy(doc).orderBy(ord)
    goes_on = F.coalesce(F.lag("text").over(w).rlike(r"et al\.\s*$"), F.lit(False))
    g = sentences.withColumn("__g", F.sum((~goes_on).cast("int")).over(w))
    items = F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), "text")))
    return g.groupBy(doc, "__g").agg(F.min(ord).alias(ord), F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("text")).drop("__g")


def graph(links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a drawing: nodes by guid with their most frequent label, links with a weight. ``links``: a, b; ``labels``: guid, label."""
    e = links.groupBy("a", "b").agg(F.count("*").alias("weight"))
    ids = e.select(F.col("a").alias("guid")).union(e.select("b")).distinct()
    l = labels.groupBy("guid", "label").agg(F.count("*").alias("n")).groupBy("guid").agg(F.max_by("label", F.struct("n", "label")).alias("label"))  # noqa: E741
    return ids.join(l, "guid", "left"), e
