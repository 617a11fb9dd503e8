"""Features along ordered tokens, sentences and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance_to(tokens: DataFrame, ctx: str, pos: str, is_mark: Column, scale: float = 300.0) -> DataFrame:
    """Adds dist (signed, to the context's first mark), dist_abs and dist_scaled; null without a mark."""
    mark = F.min(F.when(is_mark, F.col(pos))).over(Window.partitionBy(ctx))
    d = tokens.withColumn("dist", F.col(pos) - mark)
    return d.withColumn("dist_abs", F.abs("dist")).withColumn("dist_scaled", F.abs("dist") / scale)


def previous(tokens: DataFrame, ctx: str, pos: str, feature: str, k: int) -> DataFrame:
    """Adds prev_1 .. prev_k: the feature of the tokens before."""
    w = Window.partitionBy(ctx).orderBy(pos)
    return tokens.withColumns({f"prev_{i}": F.lag(feature, i).over(w) for i in range(1, k + 1)})


def positional(sentences: DataFrame, doc: str = "doc", ord: str = "ord", para: str = "para", header: str = "is_header") -> DataFrame:
    """Adds section number, sentences since the last header (10 at most), place in the paragraph (10 at most), and fifth of the section and third of the paragraph."""
    w = Window.partitionBy(doc).orderBy(ord)
    s = sentences.withColumn("section_no", F.sum(F.col(header).cast("int")).over(w))
    sec, par = Window.partitionBy(doc, "section_no"), Window.partitionBy(doc, para)
    in_sec, in_par = F.row_number().over(sec.orderBy(ord)), F.row_number().over(par.orderBy(ord))
    return s.withColumns({
        "since_header": F.least(in_sec - 1, F.lit(10)), "in_paragraph": F.least(in_par, F.lit(10)),
        "section_slice": F.floor((in_sec - 1) * 5 / F.count("*").over(sec)).cast("int") + 1, "paragraph_slice": F.floor((in_par - 1) * 3 / F.count("*").over(par)).cast("int") + 1,
    })


def slice_of(pos: Column, length: Column, parts: int = 2) -> Column:
    return F.least(F.floor(pos * parts / length).cast("int") + 1, F.lit(parts))


def length_bucket(n: Column, step: int = 3) -> Column:
    return (F.floor(n / step) * step).cast("int")


def near(sentences: DataFrame, flag: Column, doc: str = "doc", ord: str = "ord", reach: int = 2) -> DataFrame:
    """Adds near: whether a flagged sentence is within ``reach``."""
    w = Window.partitionBy(doc).orderBy(ord).rowsBetween(-reach, reach)
    return sentences.withColumn("near", F.max(F.coalesce(flag, F.lit(False)).cast("int")).over(w) == 1)


def best_bigrams(tokens: DataFrame, ctx: str, pos: str, word: str, k: int = 20) -> DataFrame:
    """(ctx, a, b, n, chi2): each context's k bigrams of highest chi-square within it; ties by the words."""
    w = Window.partitionBy(ctx).orderBy(pos)
    pairs = tokens.select(ctx, F.col(word).alias("a"), F.lead(word).over(w).alias("b")).where("b is not null")
    n = pairs.groupBy(ctx, "a", "b").agg(F.count("*").alias("n"))
    by = lambda c: Window.partitionBy(ctx, *c)
    t = n.withColumns({"na": F.sum("n").over(by(["a"])), "nb": F.sum("n").over(by(["b"])), "all": F.sum("n").over(by([]))})
    o11, o12, o21 = F.col("n"), F.col("na") - F.col("n"), F.col("nb") - F.col("n")
    o22 = F.col("all") - F.col("na") - F.col("nb") + F.col("n")
    den = (o11 + o12) * (o21 + o22) * (o11 + o21) * (o12 + o22)
    d = (o11 * o22 - o12 * o21).cast("double")
    t = t.withColumn("chi2", F.when(den > 0, F.col("all") * d * d / den).otherwise(0.0))
    r = F.row_number().over(Window.partitionBy(ctx).orderBy(F.desc("chi2"), "a", "b"))
    return t.withColumn("k", r).where(F.col("k") <= k).select(ctx, "a", "b", "n", "chi2")


def pad(words: Column, length: int, filler: str = "") -> Column:
    return F.slice(F.concat(words, F.array_repeat(F.lit(filler), length)), 1, length)


def unpad(words: Column, filler: str = "") -> Column:
    return F.filter(words, lambda t: t != filler)


def first_words(words: Column, n: int = 4) -> Column:
    """The first n words of a sentence, joined by blanks."""
    return F.array_join(F.slice(words, 1, n), " ")


def with_ends(sentences: DataFrame, words: Column, features: list[str], end: str = "#stop#") -> DataFrame:
    """(ctx, ord, pos, token, features): the words of each sentence and an end token, each with the sentence's features. Needs ctx, ord; pos counts from 1."""
    return sentences.select("ctx", "ord", F.posexplode(F.concat(words, F.array(F.lit(end)))).alias("pos", "token"), *features).withColumn("pos", F.col("pos") + 1)


def feature_matrix(rows: DataFrame, columns: list[str], out: str = "features"):  # noqa: ANN201
    """Adds a dense vector of numeric, boolean and null-safe columns in the given order."""
    from pyspark.ml.feature import VectorAssembler

    plain = rows.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol=out).transform(plain).drop(*[f"__{c}" for c in columns])
